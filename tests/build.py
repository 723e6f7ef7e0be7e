"""Small binary fixtures: compiled classes, binary XML and resource tables, written from a description."""

import io
import struct
import zipfile


def uleb(n):
    out = b""
    while True:
        byte, n = n & 0x7F, n >> 7
        out += bytes([byte | (0x80 if n else 0)])
        if not n:
            return out


def sleb(n):
    out = b""
    while True:
        byte, n = n & 0x7F, n >> 7
        if (n == 0 and not byte & 0x40) or (n == -1 and byte & 0x40):
            return out + bytes([byte])
        out += bytes([byte | 0x80])


def mutf8(text):
    out = b""
    for c in text.encode("utf-16-be", "surrogatepass").hex(" ", 2).split():
        u = int(c, 16)
        if u == 0:
            out += b"\xc0\x80"
        elif u < 0x80:
            out += bytes([u])
        elif u < 0x800:
            out += bytes([0xC0 | u >> 6, 0x80 | u & 0x3F])
        else:
            out += bytes([0xE0 | u >> 12, 0x80 | u >> 6 & 0x3F, 0x80 | u & 0x3F])
    return out


class DexBuilder:
    """classes: dicts of name, super, interfaces, access, fields, methods, annotations; code words may hold pool callables."""

    def __init__(self):
        self.strings, self.types, self.protos, self.fields, self.methods, self.classes = [], [], [], [], [], []

    @staticmethod
    def _put(pool, item):
        if item not in pool:
            pool.append(item)
        return pool.index(item)

    def string(self, s):
        return self._put(self.strings, s)

    def type(self, t):
        self.string(t)
        return self._put(self.types, t)

    def proto(self, returns, params):
        self.type(returns)
        for p in params:
            self.type(p)
        self.string("S")
        return self._put(self.protos, (returns, tuple(params)))

    def field(self, owner, kind, name):
        self.type(owner), self.type(kind), self.string(name)
        return self._put(self.fields, (owner, kind, name))

    def method(self, owner, name, returns, params):
        self.type(owner), self.string(name), self.proto(returns, params)
        return self._put(self.methods, (owner, (returns, tuple(params)), name))

    def add(self, name, **spec):
        self.type(name)
        if spec.get("super"):
            self.type(spec["super"])
        for i in spec.get("interfaces", []):
            self.type(i)
        spec["name"] = name
        for kind, fname, *_ in spec.get("fields", []):
            self.field(name, kind, fname)
        for m in spec.get("methods", []):
            self.method(name, m["name"], m["returns"], m.get("params", []))
        self.classes.append(spec)
        return self

    def value(self, v):
        """(kind, payload) as an encoded value."""
        kind, payload = v
        if kind == "string":
            return bytes([0x17 | 3 << 5]) + struct.pack("<I", self.string(payload))
        if kind == "type":
            return bytes([0x18 | 3 << 5]) + struct.pack("<I", self.type(payload))
        if kind == "int":
            return bytes([0x04 | 3 << 5]) + struct.pack("<i", payload)
        if kind == "boolean":
            return bytes([0x1F | (1 if payload else 0) << 5])
        if kind == "null":
            return bytes([0x1E])
        if kind == "array":
            return bytes([0x1C]) + uleb(len(payload)) + b"".join(self.value(x) for x in payload)
        if kind == "annotation":
            return bytes([0x1D]) + self.annotation(*payload)
        raise ValueError(kind)

    def annotation(self, kind, elements):
        return uleb(self.type(kind)) + uleb(len(elements)) + b"".join(uleb(self.string(n)) + self.value(v) for n, v in elements)

    def build(self):
        # Encode what adds to the pools first, so that indices are final.
        for spec in self.classes:
            for note in spec.get("annotations", []):
                self.annotation(note["type"], note.get("elements", []))
            for v in spec.get("values", []):
                self.value(v)
            for m in spec.get("methods", []):
                for _, _, handlers in m.get("tries", []):
                    for t, _ in handlers:
                        if t:
                            self.type(t)
        sizes = [len(x) for x in (self.strings, self.types, self.protos, self.fields, self.methods, self.classes)]
        widths = (4, 4, 12, 8, 8, 32)
        offsets, at = [], 112
        for n, w in zip(sizes, widths, strict=True):
            offsets.append(at if n else 0)
            at += n * w
        data = bytearray()
        base = at

        def here(align=1):
            while (base + len(data)) % align:
                data.append(0)
            return base + len(data)

        def type_list(items):
            if not items:
                return 0
            place = here(4)
            data.extend(struct.pack("<I", len(items)) + b"".join(struct.pack("<H", self.types.index(t)) for t in items))
            return place

        def put(raw, align=1):
            place = here(align)
            data.extend(raw)
            return place

        strings = [put(uleb(len(s)) + mutf8(s) + b"\0") for s in self.strings]
        proto_lists = [type_list(p) for _, p in self.protos]
        class_rows = []
        for spec in self.classes:
            interfaces = type_list(spec.get("interfaces", []))
            bodies = {}
            for m in spec.get("methods", []):
                if m.get("code") is None:
                    continue
                words = [w() if callable(w) else w for w in m["code"]]
                tries = m.get("tries", [])
                raw = struct.pack("<4H2I", m.get("registers", 4), m.get("ins", 1), m.get("outs", 2), len(tries), 0, len(words)) + struct.pack(f"<{len(words)}H", *[w & 0xFFFF for w in words])
                if tries:
                    raw += b"\0\0" * (len(words) % 2)
                    lists, items = uleb(len(tries)), b""
                    for start, count, handlers in tries:
                        items += struct.pack("<IHH", start, count, len(lists))
                        typed = [(t, a) for t, a in handlers if t]
                        bare = [a for t, a in handlers if not t]
                        lists += sleb(-len(typed) if bare else len(typed)) + b"".join(uleb(self.types.index(t)) + uleb(a) for t, a in typed) + b"".join(uleb(a) for a in bare)
                    raw += items + lists
                bodies[m["name"], m["returns"], tuple(m.get("params", []))] = put(raw, 4)
            groups = [[], [], [], []]
            for kind, name, access, *_ in spec.get("fields", []):
                groups[0 if access & 8 else 1].append((self.fields.index((spec["name"], kind, name)), uleb(access)))
            for m in spec.get("methods", []):
                key = (spec["name"], (m["returns"], tuple(m.get("params", []))), m["name"])
                access = m.get("access", 1)
                direct = access & 0xA or m["name"].startswith("<")
                code = bodies.get((m["name"], m["returns"], tuple(m.get("params", []))), 0)
                groups[2 if direct else 3].append((self.methods.index(key), uleb(access) + uleb(code)))
            raw = b"".join(uleb(len(g)) for g in groups)
            for g in groups:
                last = 0
                for index, rest in sorted(g):
                    raw += uleb(index - last) + rest
                    last = index
            body = put(raw)
            values = put(uleb(len(spec["values"])) + b"".join(self.value(v) for v in spec["values"])) if spec.get("values") else 0
            notes = self._notes(spec, put)
            parent = self.types.index(spec["super"]) if spec.get("super") else 0xFFFFFFFF
            class_rows.append(struct.pack("<8I", self.types.index(spec["name"]), spec.get("access", 1), parent, interfaces, 0xFFFFFFFF, notes, body, values))
        tables = struct.pack(f"<{len(strings)}I", *strings)
        tables += b"".join(struct.pack("<I", self.strings.index(t)) for t in self.types)
        tables += b"".join(struct.pack("<3I", self.strings.index("S"), self.types.index(r), place) for (r, _), place in zip(self.protos, proto_lists, strict=True))
        tables += b"".join(struct.pack("<HHI", self.types.index(o), self.types.index(k), self.strings.index(n)) for o, k, n in self.fields)
        tables += b"".join(struct.pack("<HHI", self.types.index(o), self.protos.index(p), self.strings.index(n)) for o, p, n in self.methods)
        tables += b"".join(class_rows)
        head = b"dex\n035\0" + bytes(24) + struct.pack("<3I", base + len(data), 112, 0x12345678) + bytes(12)
        for n, o in zip(sizes, offsets, strict=True):
            head += struct.pack("<2I", n, o)
        head += struct.pack("<2I", len(data), base)
        return head + tables + bytes(data)

    def _notes(self, spec, put):
        found = {"class": [], "field": {}, "method": {}, "parameter": {}}
        for note in spec.get("annotations", []):
            item = put(bytes([note.get("visibility", 1)]) + self.annotation(note["type"], note.get("elements", [])))
            on = note.get("on", ("class",))
            if on[0] == "class":
                found["class"].append(item)
            elif on[0] == "parameter":
                found["parameter"].setdefault(on[1], {}).setdefault(on[2], []).append(item)
            else:
                found[on[0]].setdefault(on[1], []).append(item)
        if not spec.get("annotations"):
            return 0
        group = lambda items: put(struct.pack(f"<{len(items) + 1}I", len(items), *items), 4) if items else 0
        own = group(found["class"])
        fields = sorted((k, group(v)) for k, v in found["field"].items())
        methods = sorted((k, group(v)) for k, v in found["method"].items())
        listed = []
        for k, by in sorted(found["parameter"].items()):
            sets = [group(by.get(n, [])) for n in range(max(by) + 1)]
            listed.append((k, put(struct.pack(f"<{len(sets) + 1}I", len(sets), *sets), 4)))
        raw = struct.pack("<4I", own, len(fields), len(methods), len(listed))
        return put(raw + b"".join(struct.pack("<2I", *x) for x in [*fields, *methods, *listed]), 4)


def string_pool(strings, wide=False):
    body, offsets = b"", []
    for s in strings:
        offsets.append(len(body))
        if wide:
            raw = s.encode("utf-16-le")
            body += struct.pack("<H", len(raw) // 2) + raw + b"\0\0"
        else:
            raw = s.encode()
            body += bytes([len(s), len(raw)]) + raw + b"\0"
    body += bytes(-len(body) % 4)
    first = 28 + 4 * len(strings)
    return struct.pack("<HHI5I", 1, 28, first + len(body), len(strings), 0, 0 if wide else 0x100, first, 0) + struct.pack(f"<{len(strings)}I", *offsets) + body


ANDROID = "http://schemas.android.com/apk/res/android"


def binary_xml(tree, ids=None):
    """tree: (tag, {name: text or (kind, data)}, children); `android:` names are in the namespace."""
    strings, out = ["android", ANDROID], b""
    index = lambda s: strings.index(s) if s in strings else (strings.append(s), len(strings) - 1)[1]
    ids = ids or {}
    # Names that are found by id come first, as the resource map does.
    mapped = list(ids)
    strings = [("" if ids[n][1] else n) for n in mapped] + strings

    def chunk(kind, body):
        return struct.pack("<HHI2I", kind, 16, 16 + len(body), 1, 0xFFFFFFFF) + body

    def node(one):
        nonlocal out
        tag, attributes, children = one
        cells = b""
        for name, value in attributes.items():
            space = index(ANDROID) if name.startswith("android:") else 0xFFFFFFFF
            bare = name.removeprefix("android:")
            own = mapped.index(bare) if bare in mapped else index(bare)
            if isinstance(value, tuple):
                cells += struct.pack("<3IHBBI", space, own, 0xFFFFFFFF, 8, 0, *value)
            else:
                k = index(value)
                cells += struct.pack("<3IHBBI", space, own, k, 8, 0, 3, k)
        out += chunk(0x0102, struct.pack("<2I6H", 0xFFFFFFFF, index(tag), 20, 20, len(attributes), 0, 0, 0) + cells)
        for c in children:
            node(c)
        out += chunk(0x0103, struct.pack("<2I", 0xFFFFFFFF, index(tag)))

    out += chunk(0x0100, struct.pack("<2I", index("android"), index(ANDROID)))
    node(tree)
    out += chunk(0x0101, struct.pack("<2I", index("android"), index(ANDROID)))
    table = struct.pack("<HHI", 0x0180, 8, 8 + 4 * len(mapped)) + b"".join(struct.pack("<I", ids[n][0]) for n in mapped) if mapped else b""
    body = string_pool(strings) + table + out
    return struct.pack("<HHI", 3, 8, 8 + len(body)) + body


def resource_table(package, number, types, values):
    """values: (type, key, language, (kind, data), layout) with layout dense, sparse, offset16 or compact."""
    strings = ["Hello café", "res/layout/main.xml"]
    keys = sorted({v[1] for v in values})
    head = b""
    blocks = b""
    for t, kind in enumerate(types, 1):
        groups = {}
        for v in values:
            if v[0] == kind:
                groups.setdefault((v[2], v[4]), []).append(v)
        entries = sorted({v[1] for v in values if v[0] == kind})
        for (language, layout), own in sorted(groups.items()):
            config = bytearray(64)
            struct.pack_into("<I", config, 0, 64)
            config[8 : 8 + len(language)] = language.encode()
            rows, places = b"", {}
            for _, key, _, (vkind, data), _ in own:
                places[entries.index(key)] = len(rows)
                if layout == "compact":
                    rows += struct.pack("<HHI", keys.index(key), 8 | vkind << 8, data)
                else:
                    rows += struct.pack("<HHIHBBI", 8, 0, keys.index(key), 8, 0, vkind, data)
            if layout == "sparse":
                flags, count, index = 1, len(places), b"".join(struct.pack("<HH", e, o // 4) for e, o in sorted(places.items()))
            elif layout == "offset16":
                flags, count = 2, len(entries)
                index = b"".join(struct.pack("<H", places[e] // 4 if e in places else 0xFFFF) for e in range(count))
            else:
                flags, count = 0, len(entries)
                index = b"".join(struct.pack("<I", places.get(e, 0xFFFFFFFF)) for e in range(count))
            index += bytes(-len(index) % 4)
            start = 20 + 64
            size = start + len(index) + len(rows)
            blocks += struct.pack("<HHIBBHII", 0x0201, start, size, t, flags, 0, count, start + len(index)) + bytes(config) + index + rows
    type_pool, key_pool = string_pool(types, True), string_pool(keys)
    header = 288
    head = struct.pack("<I", number) + package.encode("utf-16-le").ljust(256, b"\0") + struct.pack("<5I", header, 0, header + len(type_pool), 0, 0)
    body = type_pool + key_pool + blocks
    packed = struct.pack("<HHI", 0x0200, header, header + len(body)) + head + body
    pool = string_pool(strings)
    return struct.pack("<HHII", 2, 12, 12 + len(pool) + len(packed), 1) + pool + packed


def package(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


OBJECT = "Ljava/lang/Object;"


def hello():
    b = DexBuilder()
    b.add("Lsample/Hello;", super=OBJECT, methods=[{"name": "answer", "returns": "I", "access": 9, "registers": 1, "ins": 0, "code": [0x0013, 42, 0x000F]}])
    return b.build()


def navigation():
    """Caller -> Target, a subclass, an interface with a service annotation, fields, strings and a switch on a field."""
    b = DexBuilder()
    run = b.method("Lsample/Target;", "run", "V", ["Ljava/lang/String;", "I"])
    sub = b.method("Lsample/Sub;", "run", "V", ["Ljava/lang/String;", "I"])
    init = b.method("Lsample/Case;", "<init>", "V", ["I"])
    own = b.field("Lsample/Case;", "I", "id")
    key, other = b.string("config_key"), b.string("other")
    kind = b.type("Lsample/Target;")
    case = b.type("Lsample/Case;")
    b.add("Lsample/Target;", super=OBJECT, fields=[("Ljava/lang/String;", "NAME", 9)], values=[("string", "config_key")], methods=[{"name": "run", "returns": "V", "params": ["Ljava/lang/String;", "I"], "registers": 4, "ins": 3, "code": [0x000E]}, {"name": "only", "returns": "V", "code": [0x000E]}])
    b.add("Lsample/Sub;", super="Lsample/Target;", methods=[{"name": "run", "returns": "V", "params": ["Ljava/lang/String;", "I"], "registers": 4, "ins": 3, "code": [0x000E]}])
    b.add("Lsample/Case;", super=OBJECT, fields=[("I", "id", 0x12)], methods=[
        {"name": "<init>", "returns": "V", "params": ["I"], "access": 0x10001, "registers": 2, "ins": 2, "code": [0x1059 | 0, own, 0x000E]},
        # iget v0, v2, id; const/4 v1, 3; if-ne v0, v1, +3; nop; return-void; return-void
        {"name": "invoke", "returns": "V", "registers": 3, "ins": 1, "code": [0x2052, own, 0x3112, 0x1033, 3, 0x0000, 0x000E]},
    ])
    b.add("Lsample/Caller;", super=OBJECT, methods=[
        # new-instance v0, Target; const-string v1, config_key; const/4 v2, 7; invoke-virtual {v0,v1,v2} run; return-void
        {"name": "call", "returns": "V", "access": 9, "registers": 3, "ins": 0, "outs": 3, "code": [0x0022, kind, 0x011A, key, 0x7212, 0x306E, run, 0x0210, 0x000E]},
        # invoke-virtual through the subclass, with an unknown string
        {"name": "through", "returns": "V", "params": ["Ljava/lang/String;"], "registers": 4, "ins": 2, "outs": 3, "code": [0x0112, 0x306E, sub, 0x0132, 0x000E], "tries": [(1, 3, [("Ljava/lang/Exception;", 4), (None, 4)])]},
        # new-instance v0, Case; const/4 v1, 3; invoke-direct {v0, v1} <init>; return-void
        {"name": "make", "returns": "V", "access": 9, "registers": 2, "ins": 0, "code": [0x0022, case, 0x3112, 0x2070, init, 0x0010, 0x001A, other, 0x000E]},
    ])
    get = b.method("Lsample/Api;", "get", "V", ["Ljava/lang/String;"])
    b.add("Lsample/Api;", super=OBJECT, access=0x601, methods=[{"name": "get", "returns": "V", "params": ["Ljava/lang/String;"], "access": 0x401}], annotations=[
        {"type": "Lhttp/GET;", "on": ("method", get), "elements": [("value", ("string", "/users/{id}"))]},
        {"type": "Lhttp/Path;", "on": ("parameter", get, 0), "elements": [("value", ("string", "id"))]},
        {"type": "Lkotlin/Metadata;", "elements": [("d2", ("array", [("string", "Lsample/Api;"), ("string", "fetchUser")])), ("k", ("int", -1)), ("x", ("annotation", ("Lnote/Inner;", [("on", ("boolean", True))])))]},
    ])
    b.add("Lsample/Real;", super=OBJECT, interfaces=["Lsample/Api;"], methods=[{"name": "get", "returns": "V", "params": ["Ljava/lang/String;"], "registers": 2, "ins": 2, "code": [0x000E]}])
    create = b.method("Lretrofit2/Retrofit;", "create", OBJECT, ["Ljava/lang/Class;"])
    view = b.method("Landroid/app/Activity;", "setContentView", "V", ["I"])
    api = b.type("Lsample/Api;")
    # const-class v0, Api; invoke-virtual {v2, v0} create; const v0, 0x7f020000; invoke-virtual {v1, v0} setContentView; return-void
    boot = [0x001C, api, 0x206E, create, 0x0002, 0x0014, 0x0000, 0x7F02, 0x206E, view, 0x0001, 0x000E]
    note = {"type": "Lnav/Destination;", "elements": [("uri", ("array", [("string", "app://boot")]))]}
    b.add("Lsample/Boot;", super=OBJECT, methods=[{"name": "start", "returns": "V", "registers": 3, "ins": 1, "code": boot}], annotations=[note])
    return b.build()


MANIFEST = ("manifest", {"package": "sample.app", "android:versionCode": "7"}, [
    ("uses-sdk", {"android:targetSdkVersion": (0x10, 30)}, []),
    ("application", {"android:label": "x"}, [
        ("activity", {"android:name": ".Main", "android:exported": (0x12, 0xFFFFFFFF)}, [
            ("intent-filter", {}, [("action", {"android:name": "android.intent.action.MAIN"}, []), ("category", {"android:name": "android.intent.category.LAUNCHER"}, [])]),
            ("intent-filter", {}, [("data", {"android:scheme": "https", "android:host": "Example.com"}, []), ("data", {"android:pathPrefix": "/open"}, [])]),
        ]),
        ("service", {"android:name": "sample.Target"}, []),
    ]),
])
NAVIGATION = ("navigation", {}, [("fragment", {"android:id": "@id/home"}, [("deepLink", {"app:uri": "app://home/{id}"}, [])])])
LAYOUT = ("sample.Widget", {"tools:context": ".Main"}, [("fragment", {"android:name": "sample.Part"}, []), ("include", {"layout": "@layout/bar"}, [])])


def app(split=None):
    tree = MANIFEST if split is None else ("manifest", {"package": "sample.app", "android:versionCode": "7", "split": split}, [])
    members = {"AndroidManifest.xml": binary_xml(tree, {"exported": (0x01010010, True)})}
    if split is None:
        table = resource_table("sample.app", 127, ["string", "layout"], [("string", "title", "", (3, 0), "dense"), ("string", "title", "fr", (0x12, 1), "dense"), ("string", "alias", "", (1, 0x7F010001), "dense"), ("layout", "main", "", (3, 1), "sparse")])
        members |= {"classes.dex": navigation(), "resources.arsc": table, "res/navigation/nav.xml": binary_xml(NAVIGATION), "res/layout/main.xml": binary_xml(LAYOUT), "assets/notes.txt": b"alpha beta\nbeta\n", "assets/pic.png": b"\x89PNG\r\n\x1a\nxx", "classes1.dex": b"no class"}
    else:
        members |= {"classes.dex": hello(), "assets/extra.txt": b"split asset"}
    return package(members)
