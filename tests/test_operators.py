import pytest
from pyspark.sql import functions as F

from lodestack.functions import manifest as M
from lodestack.functions import names as N
from lodestack.functions import numbers as B
from lodestack.functions import scope as S
from lodestack.functions import text as T
from lodestack.functions import tristate as V
from lodestack.operators import aggregates as A
from lodestack.operators import graph as G
from lodestack.operators import markup as K
from lodestack.operators import paging as P
from lodestack.operators import references as R
from lodestack.operators import resources as X
from lodestack.operators import search as Q


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_selectors():
    for text in ("La/B;->m(I)V", "a/B.m(I)V", "a.B#m(I)V", "a.B.m:(I)V", " a.B.m(I)V "):
        assert N.normal_selector(text) == "a.B.m(I)V"
    assert N.is_complete("a.B.m([I)La/C;") and not N.is_complete("a.B.m")
    assert N.owner_of("a.B.f:I") == "a.B"
    assert 'Java.use("a.B")' in N.tracing_snippet("La/B;->m(I[J)V") and 'overload("int", "[J")' in N.tracing_snippet("La/B;->m(I[J)V")


def test_types(spark):
    lit = F.lit
    assert [one(spark, N.type_name(lit(d))) for d in ("Lp/C;", "[[I", "J", "odd")] == ["p.C", "int[][]", "long", "odd"]
    assert one(spark, N.descriptors(lit("I[[Lp/C;J[Z"))) == ["I", "[[Lp/C;", "J", "[Z"]
    assert one(spark, N.component_type(lit("p.C[][]"))) == "p.C"


def test_numbers(spark):
    assert B.parse_value("0xffffffff", 32) == -1 and B.parse_value("-0x1", 64) == -1 and B.parse_value("7", 32) == 7
    for bad in (("0x1ffffffff", 32), (1 << 31, 32), ("1", 16)):
        with pytest.raises(ValueError):
            B.parse_value(*bad)
    assert one(spark, B.hex_pattern(F.lit(-1), 32)) == "0xffffffff" and one(spark, B.hex_pattern(F.lit(255), 64)) == "0x00000000000000ff"
    assert one(spark, B.sign_extend(F.lit(0xFFFE), 16)) == -2 and one(spark, B.high16(F.lit(1))) == 65536


def test_scopes(spark):
    rows = spark.createDataFrame([("a.B",), ("a.B.C",), ("a.B$C",), ("a.Bc",), ("x.yz.abc",), ("long.name",)], "n string")
    pick = lambda c: sorted(r["n"] for r in rows.where(c).collect())
    assert pick(S.in_scope(F.col("n"), ["a.B"])) == ["a.B", "a.B.C"]
    assert pick(S.in_scope(F.col("n"), [S.OBFUSCATED])) == ["a.B", "a.B$C", "a.B.C", "a.Bc", "x.yz.abc"]
    assert pick(S.excluded(F.col("n"), ["a.B.*", " ", "*"])) == ["a.B.C"]
    assert pick(S.package_of(F.col("n")) == "x.yz") == ["x.yz.abc"] and len(pick(S.in_scope(F.col("n"), []))) == 6


def test_text(spark):
    with pytest.raises(ValueError):
        T.pattern("(?=x)", regex=True)
    assert one(spark, T.count_literal(F.lit("aaaa"), "aa")) == 2
    assert one(spark, T.whole_word(F.lit("the other the_ the"), "the")) == 2
    assert [one(spark, T.line_count(F.lit(t))) for t in ("", "a", "a\n", "a\nb", "\n")] == [0, 1, 1, 2, 1]
    page = one(spark, T.text_page(F.lit("α😀bcd"), 1, 2))
    assert page["page"] == "😀b" and page["next_offset"] == 3
    with pytest.raises(ValueError):
        T.text_page(F.lit("x"), 0, 0)


def test_matches_offsets_and_previews(spark):
    docs = spark.createDataFrame([(1, "α😀 key\nsecond " + "p" * 70 + "KEY" + "q" * 300), (2, None), (3, "")], "id long, t string")
    rows = Q.matches(docs, "id", "t", "key", case_sensitive=False).collect()
    assert [(r["start"], r["end"], r["line"], r["column"]) for r in rows] == [(3, 6, 1, 4), (84, 87, 2, 78)]
    assert rows[1]["preview"].startswith("…ppp") and len(rows[1]["preview"]) == 1 + 60 + 180
    assert Q.matches(docs, "id", "t", "x*", use_regex=True).count() == 0


def test_enclosing_prefers_the_last_definition_at_or_before(spark):
    hits = spark.createDataFrame([("d", 1), ("d", 5), ("d", 9), ("e", 3)], "doc string, at long")
    definitions = spark.createDataFrame([("d", 5, "f"), ("d", 7, "g")], "doc string, s long, name string")
    got = {(r["doc"], r["at"]): r["name"] for r in Q.enclosing(hits, definitions, ["doc"], "at", "s", ["name"]).collect()}
    assert got == {("d", 1): None, ("d", 5): "f", ("d", 9): "g", ("e", 3): None}


def test_indexed_search_equals_scan(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    index = Q.trigram_index(docs, "doc_id", "text")
    for query in ("thnd", "the", "zzzq", "ou", "é l"):
        both = [sorted(map(tuple, f.collect())) for f in (Q.counts(docs, "doc_id", "text", query), Q.search_indexed(docs, index, "doc_id", "text", query))]
        assert both[0] == both[1]


def test_pages_and_cursors(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    pages, offset = [], 0
    while offset is not None:
        rows = P.page(df, ["k"], offset, 10).orderBy("k").collect()
        pages += [r["k"] for r in rows]
        assert {r["total"] for r in rows} == {25}
        offset = rows[0]["next_offset"]
    assert pages == list(range(25))
    with pytest.raises(P.ContractError):
        P.page(df, ["k"], 0, 501)
    me = P.identity(tool="x", query="q")
    cursor = P.seal(me, [9])
    assert [r["k"] for r in P.after(df, ["k"], P.unseal(cursor, me)).orderBy("k").limit(2).collect()] == [10, 11]
    for bad, owner, code in ((cursor, "other", "CURSOR_MISMATCH"), (cursor[:-4] + "AAAA", me, "INVALID_CURSOR"), ("%%", me, "INVALID_CURSOR")):
        with pytest.raises(P.ContractError, match=code):
            P.unseal(bad, owner)
    small_rows = P.page_by_bytes(df, ["k"], F.lit(6000), budget=16_384)
    assert [r["k"] for r in small_rows.orderBy("k").collect()] == [0, 1]
    with pytest.raises(Exception, match="PAGE_TOO_SMALL"):
        P.page_by_bytes(df, ["k"], F.lit(20_000), budget=16_384).collect()
    assert [r["k"] for r in P.positions(df, [F.desc("k")]).where("position < 2").orderBy("position").collect()] == [24, 23]


def test_digest_is_of_the_whole_order(spark):
    import hashlib

    df = spark.range(1000).repartition(7).select(F.col("id"), F.col("id").cast("string").alias("r"))
    got = P.ordered_digest(df, F.col("r"), ["id"]).collect()[0]
    assert got["n_records"] == 1000 and got["sha256"] == hashlib.sha256("".join(f"{i}\n" for i in range(1000)).encode()).hexdigest()
    assert P.ordered_digest(df.limit(0), F.col("r"), ["id"]).collect()[0]["sha256"] == hashlib.sha256(b"").hexdigest()


def test_three_values(spark):
    rows = spark.createDataFrame([("a", True), ("a", None), ("b", False), ("b", None), ("c", False)], "k string, v boolean")
    assert {r["k"]: r["x"] for r in rows.groupBy("k").agg(V.any_of(F.col("v")).alias("x")).collect()} == {"a": True, "b": None, "c": False}
    assert rows.where(V.matches(F.col("v"), None)).count() == 2
    assert {r["k"]: (r["total"], r["yes"], r["no"], r["unresolved"]) for r in A.record_counts(rows, "k", F.col("v")).collect()} == {"a": (2, 1, 0, 1), "b": (2, 0, 1, 1), "c": (1, 0, 1, 0), None: (5, 1, 2, 2)}


@pytest.mark.parametrize(
    ("declared", "kind", "filters", "sdk", "want"),
    [("true", "service", False, None, True), ("false", "provider", True, 10, False), ("@bool/x", "service", True, 10, None), (None, "provider", False, 16, True), (None, "provider", False, 17, False), (None, "provider", False, None, None), (None, "service", True, None, None), (None, "service", True, 31, None), (None, "service", True, 30, True), (None, "service", False, None, False)],
)
def test_exported(spark, declared, kind, filters, sdk, want):
    assert one(spark, M.exported(F.lit(declared).cast("string"), F.lit(kind), F.lit(filters), F.lit(sdk).cast("int"))) is want


def test_manifest_scalars(spark):
    lit = lambda v: F.lit(v).cast("string")
    assert [one(spark, M.full_class(lit(n), lit("a.b"))) for n in (".X", "X", "c.X", "@x")] == ["a.b.X", "a.b.X", "c.X", "@x"]
    assert [one(spark, M.enabled(lit(a), lit(b))) for a, b in ((None, None), ("false", "@x"), ("@x", None), ("true", "false"))] == [True, False, None, False]
    state = [one(spark, M.permission_state(lit(a), lit(b))) for a, b in ((None, None), ("", "p"), (None, "p"), ("q", "p"), ("@r", None))]
    assert [(s["permission"], s["state"]) for s in state] == [(None, "none"), (None, "explicitly_none"), ("p", "inherited"), ("q", "declared"), (None, "unresolved")]
    assert one(spark, M.protection(F.lit(0x12))) == "signature|privileged"


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "c"), ("c", "d")], "source string, target string")
    roots = spark.createDataFrame([("a",)], "root string")
    get = lambda df: {r["node"]: r["depth"] for r in df.collect()}
    assert get(G.walk(edges, roots, "callees", 10)) == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert get(G.walk(edges, roots, "callers", 1)) == {"a": 0, "c": 1}
    assert get(G.walk(edges, roots, "both", 1)) == {"a": 0, "b": 1, "c": 1}
    nodes = G.walk(edges, roots, "callees", 10)
    kept, shown, truncated = G.capped(nodes, edges, 3, 10)
    assert truncated and sorted(r["node"] for r in kept.collect()) == ["a", "b", "c"] and shown.count() == 3
    masks = G.propagate(edges, spark.createDataFrame([("a", 1), ("x", 2)], "node string, mask int"))
    assert {r["node"]: r["mask"] for r in masks.collect()} == {"a": 3, "b": 3, "c": 3, "d": 3, "x": 2}
    with pytest.raises(ValueError):
        G.walk(edges, roots, "sideways", 1)


def test_assignable(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("z", "gone")], "child string, parent string")
    closed = G.closure(edges)
    loaded = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "n string")
    pairs = spark.createDataFrame([("c", "a"), ("a", "c"), ("z", "a"), ("c", "c")], "sub string, super string")
    assert {(r["sub"], r["super"]): r["assignable"] for r in G.assignable(closed, pairs, loaded).collect()} == {("c", "a"): True, ("a", "c"): False, ("z", "a"): None, ("c", "c"): True}


def test_overrides(spark):
    columns = "class_id string, package string, name string, signature string, is_static boolean, is_private boolean, is_final boolean, is_package_private boolean"
    row = lambda c, p, n, **k: (c, p, n, f"{n}()V", k.get("s", False), k.get("p", False), k.get("f", False), k.get("pp", False))
    methods = spark.createDataFrame([row("a.A", "a", "run"), row("a.A", "a", "fix", f=True), row("a.A", "a", "own", pp=True), row("b.B", "b", "run"), row("b.B", "b", "fix"), row("b.B", "b", "own"), row("a.C", "a", "own")], columns)
    up = spark.createDataFrame([("b.B", "a.A", 1), ("a.C", "a.A", 1)], "node string, ancestor string, distance int")
    assert sorted(tuple(r) for r in G.overrides(methods, up).collect()) == [("a.A.own()V", "a.C.own()V"), ("a.A.run()V", "b.B.run()V")]


def test_alias_chains(spark):
    rows = [(1, 2), (2, 3), (3, 9), (4, 5), (5, 4), (6, 6), (7, 4)]
    got = {r["start"]: (r["target"], r["hops"], r["status"]) for r in X.follow(spark.createDataFrame(rows, "start long, next long")).collect()}
    cycle = (None, None, "alias_cycle")
    assert got == {1: (9, 3, "resolved"), 2: (9, 2, "resolved"), 3: (9, 1, "resolved"), 4: cycle, 5: cycle, 6: cycle, 7: cycle}


def test_long_alias_chains_are_no_cycles(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500)], "start long, next long")
    got = {r["start"]: r for r in X.follow(chain).collect()}
    assert {i: (r["target"], r["hops"]) for i, r in got.items() if i < 500} == {i: (200, 200 - i) for i in range(200)}
    assert {i for i, r in got.items() if r["status"] == "alias_cycle"} == {500, 501}
    assert {i for i, r in got.items() if r["status"] == "too_deep"} == {i for i in range(200) if 200 - i > X.ALIAS_LEVELS}


def test_traversals_end_whole_or_with_an_error(spark):
    path = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(12)], "source string, target string")
    seed = spark.createDataFrame([("n00", 1)], "node string, mask int")
    assert G.propagate(path, seed).count() == 13
    with pytest.raises(ValueError):
        G.propagate(path, seed, rounds=5)
    tree = path.select(F.col("source").alias("child"), F.col("target").alias("parent"))
    assert G.descendants(tree, spark.createDataFrame([("n12",)], "root string")).count() == 12
    with pytest.raises(ValueError):
        G.descendants(tree, spark.createDataFrame([("n12",)], "root string"), levels=5)
    member = spark.createDataFrame([("n00", "f()V")], "owner string, member string")
    declared = spark.createDataFrame([("n12", "f()V")], "owner string, member string")
    assert G.canonical(member, declared, tree).first()["declaring"] == "n12"
    with pytest.raises(ValueError):
        G.canonical(member, declared, tree, levels=5)
    facts = spark.createDataFrame([("n00", False), ("n03", None), ("n06", True)], "node string, exposed boolean")
    got = {r["node"]: r["exposed"] for r in G.exposure(tree, facts).collect()}
    assert [got[f"n{i:02}"] for i in (0, 2, 3, 5, 6, 12)] == [False, False, None, None, True, True]


def test_field_declarations(spark):
    classes = [(c,) for c in ("A", "B", "I", "J", "K", "P", "X", "Y", "Q", "C1", "C2", "Z")]
    tree = [("A", "I", "interface"), ("A", "P", "super"), ("B", "I", "interface"), ("B", "J", "interface"), ("K", "I", "interface"), ("P", "gone", "super"), ("X", "K", "interface"), ("X", "I", "interface"), ("Y", "P", "super"), ("Q", "lost", "interface"), ("Q", "I", "interface"), ("C1", "C2", "super"), ("C2", "C1", "super"), ("Z", "A", "super")]
    fields = [("I", "f"), ("J", "f"), ("P", "g"), ("A", "own"), ("P", "own")]
    wanted = [(c, m) for (c,) in classes for m in ("f", "g", "own")] + [("gone", "f"), ("A", "f"), ("A", "none")]
    schema = "owner string, member string"
    rows = G.declared_fields(spark.createDataFrame(wanted, schema), spark.createDataFrame(fields, schema), spark.createDataFrame(classes, "class_id string"), spark.createDataFrame(tree, "child string, parent string, kind string"))
    got = {(r["owner"], r["member"]): (r["declaring"], r["complete"]) for r in rows.collect()}
    above = {}
    for child, parent, kind in tree:
        above.setdefault(child, {}).setdefault(kind, []).append(parent)

    def plain(owner, member, path=()):
        """(declaring, complete) by recursion."""
        if (owner,) not in classes or owner in path:
            return None, False
        if (owner, member) in fields:
            return owner, True
        of = [plain(i, member, (*path, owner)) for i in above.get(owner, {}).get("interface", [])]
        names = {d for d, _ in of if d}
        if not all(c for _, c in of) or len(names) > 1:
            return None, False
        if names:
            return names.pop(), True
        for parent in above.get(owner, {}).get("super", []):
            return plain(parent, member, (*path, owner))
        return None, True

    assert got == {k: plain(*k) for k in wanted}
    assert got["B", "f"] == (None, False) and got["Z", "g"] == ("P", True) and got["A", "none"] == (None, False) and got["I", "g"] == (None, True)


def test_splits_and_fallback(spark):
    columns = "id long, package string, kind string, name string, configuration string, value string"
    base = spark.createDataFrame([(1, "p", "string", "a", "", "x")], columns)
    split = spark.createDataFrame([(1, "p", "string", "a", "fr", "y")], columns)
    assert sorted(r["configuration"] for r in X.merge_splits(base, split, "s").collect()) == ["", "s:fr"]
    with pytest.raises(Exception, match="RESOURCE_CONFLICT"):
        X.merge_splits(base, split.withColumn("name", F.lit("b")), "s").collect()
    wanted = spark.createDataFrame([("a", "fr"), ("a", "de"), ("b", "fr")], "name string, configuration string")
    variants = base.unionByName(split)
    got = {(r["name"], r["configuration"]): (r["value"], r["inherited"]) for r in X.with_fallback(wanted, variants, "name", "configuration", "value").collect()}
    assert got == {("a", "fr"): ("y", False), ("a", "de"): ("x", True), ("b", "fr"): (None, None)}


def test_markup(spark):
    docs = spark.createDataFrame([("x", "<a k='1'><b>t</b><b/></a>"), ("y", "<a><b></a>"), ("z", "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>")], "d string, t string")
    rows = {(r["d"], r["idx"]): r for r in K.nodes(docs, "d", "t").collect()}
    assert [rows["x", k]["tag"] for k in range(3)] == ["a", "b", "b"] and rows["x", 1]["parent"] == 0 and rows["x", 0]["attributes"] == {"k": "1"}
    assert rows["y", 0]["error"] and rows["z", 0]["error"]
    html = K.html_rows("<p>a<br>b<p>c</div><script>var x = '<b>'</script>")
    assert [r[2] for r in html] == ["p", "br", "p", "script"]


def test_references(spark):
    calls = spark.createDataFrame([(1, "x", True), (2, "y", True), (3, "x", False), (4, None, True)], "k long, v string, known boolean")
    assert {r["k"]: r["verdict"] for r in R.argument_partition(calls, F.col("v"), F.col("known"), "x").collect()} == {1: "matched", 2: "excluded", 3: "unresolved", 4: "unresolved"}
    with pytest.raises(ValueError):
        R.integer_totals(calls, list(range(65)))
    assert [one(spark, R.access_kind(F.lit(op))) for op in (0x52, 0x66, 0x59, 0x6D, 0x6E)] == ["read", "read", "write", "write", None]
    assert one(spark, A.normal_reason(F.lit("bad 0x1F at 12 in 'x y'"))) == "bad 0x# at # in '…'"


def test_handlers_know_nothing_for_sure():
    from lodestack.operators import dataflow as D

    row = lambda pc, op, name, registers, literal=None, target=None, catches=(): {"pc": pc, "opcode": op, "name": name, "registers": list(registers), "literal": literal, "operand": None, "target": target, "catches": list(catches)}
    body = [row(0, 0x12, "const/4", [0], 1), row(1, 0x12, "const/4", [1], 2, catches=[3]), row(2, 0x28, "goto", [], target=4), row(3, 0x0D, "move-exception", [1]), row(4, 0x0F, "return", [0])]
    states = D.fixpoint(body, {}, D._constant_step, D._same)
    assert states[2] == {0: ("bits", 1), 1: ("bits", 2)} and states[3] == {} and states[4] == {}
    plain = [{**o, "catches": []} for o in body]
    assert D.fixpoint(plain, {}, D._constant_step, D._same)[4][0] == ("bits", 1)
    marks = D.fixpoint(body, {0: 1, 1: 0}, lambda one, s: dict(s), lambda a, b: a | b, caught=dict)
    assert marks[4] == {0: 1, 1: 0}


def test_protection_levels_of_every_key(spark, tmp_path):
    from lodestack.plans import catalog

    spark.range(0, 70_000, 7).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    bases = ["normal", "dangerous", "signature", "signatureOrSystem", "internal"]
    flags = ["privileged", "development", "appop", "pre23", "installer", "verifier", "preinstalled", "setup", "instant", "runtimeOnly", "oem", "vendorPrivileged"]

    def want(k):
        names = [bases[k % 16] if k % 16 < 5 else "unknown"] + [f for i, f in enumerate(flags) if k >> (4 + i) & 1]
        return "|".join(names + ([f"0x{k >> 16 << 16:x}"] if k >> 16 else []))

    got = {r["s_suppkey"]: r["protection"] for r in catalog.QUERIES["protection_levels"](spark, str(tmp_path)).collect()}
    assert got == {k: want(k) for k in range(0, 70_000, 7)}


def test_a_page_by_bytes_ends_by_bytes_only(spark):
    df = spark.range(3000).select(F.col("id").alias("k"))
    got = P.page_by_bytes(df, ["k"], F.lit(10), offset=20, budget=16_384).agg(F.count(F.lit(1)), F.min("k"), F.max("k")).collect()[0]
    assert tuple(got) == (1638, 20, 1657)


def test_whole_words_of_every_language(spark, small):
    import re

    from lodestack.plans import catalog

    texts = ["the été the", "thé the", "éthe theé the_ 9the the9 the", "the\u0301 the", None, "the-the (the)"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.whole_word(F.col("t"), "the").alias("n")).collect()
    assert {r["t"]: r["n"] for r in got if r["t"]} == {"the été the": 2, "thé the": 1, "éthe theé the_ 9the the9 the": 1, "the\u0301 the": 1, "the-the (the)": 3}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = {r["doc_id"]: n for r in docs if (n := len(re.findall(r"\bthe\b", r["text"] or "")))}
    assert {r["doc_id"]: r["n_words"] for r in catalog.QUERIES["whole_word_occurrences"](spark, small).collect()} == want


def test_forwarders_follow_moves_to_the_call_and_the_result(spark):
    from lodestack.operators import dataflow as D

    def body(method, *steps):
        return [(method, method.partition("(")[0].rpartition(".")[0], pc, op, regs, "b.B.g(IJ)I" if op == 0x71 else None) for pc, (op, regs) in enumerate(steps)]

    call, result, back = (0x71, [3, 4, 5]), (0x0A, [0]), (0x0F, [0])
    cases = {
        "a.A.plain(IJ)I": [call, result, back],
        "a.A.moved(IJ)I": [(0x01, [0, 3]), (0x04, [1, 4]), (0x71, [0, 1, 2]), (0x0A, [1]), (0x01, [0, 1]), back],
        "a.A.overlap(IJ)I": [(0x04, [6, 4]), (0x04, [5, 6]), (0x71, [3, 5, 6]), result, back],
        "a.A.swapped(IJ)I": [(0x71, [4, 5, 3]), result, back],
        "a.A.other_result(IJ)I": [call, (0x0F, [3])],
        "a.A.no_return(IJ)I": [call, result],
        "a.A.constant(IJ)I": [(0x12, [3]), call, result, back],
        "a.A.twice(IJ)I": [call, call, result, back],
        "a.A.other_type(IJ)J": [call, (0x0B, [0]), (0x10, [0])],
        "a.A.early(IJ)I": [result, call, back],
    }
    rows = [row for method, steps in cases.items() for row in body(method, *steps)]
    facts = spark.createDataFrame(rows, "method_id string, class_id string, pc long, opcode long, registers array<long>, operand string")
    missing = {"name": "string", "literal": "long", "pool": "string", "target": "long", "catches": "array<long>"}
    facts = facts.selectExpr("*", *[f"cast(null as {kind}) as {name}" for name, kind in missing.items()])
    found = D.forwarders(D.bodies(facts), facts.select("method_id").distinct())
    assert {r["method_id"] for r in found.collect()} == {"a.A.plain(IJ)I", "a.A.moved(IJ)I", "a.A.overlap(IJ)I"}


def test_kept_index_follows_its_table(spark, tmp_path):
    source = str(tmp_path / "docs")
    write = lambda rows, mode: spark.createDataFrame(rows, "id long, body string").write.mode(mode).parquet(source)
    found = lambda q: {(r["id"], r["n_matches"]) for r in Q.search_indexed(spark.read.parquet(source), Q.kept_index(spark, source, "id", "body"), "id", "body", q).collect()}
    write([(1, "a needle, a needle"), (2, "need"), (3, None), (4, "")], "overwrite")
    assert found("needle") == {(1, 2)} and found("needles") == set() and found("ne") == {(1, 2), (2, 1)}
    kept = Q.kept_index(spark, source, "id", "body")
    assert kept.inputFiles() and set(kept.inputFiles()) == set(Q.kept_index(spark, source, "id", "body").inputFiles())
    plan = kept.where(F.col("gram").isin("nee", "eed"))._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [eed,nee])" in plan and "Python" not in plan and "MapInArrow" not in plan
    write([(5, "the needle")], "append")
    assert found("needle") == {(1, 2), (5, 1)}
