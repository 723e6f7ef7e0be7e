import build as B
import pytest

from lodestack.sources import bytecode as BC
from lodestack.sources import chunks as C
from lodestack.sources.container import Container, ContainerError, check_names, is_dex, preview
from lodestack.sources.dex import Dex, DexError, flat_values, modified_utf8


def test_hello():
    dex = Dex(B.hello())
    assert [c.id for c in dex.classes] == ["sample.Hello"]
    method = dex.classes[0].methods[0]
    assert method.id == "sample.Hello.answer()I" and method.code.words == (0x0013, 42, 0x000F) and method.code.registers == 1
    found = list(BC.instructions(method.code))
    assert [(i.pc, i.name, i.literal) for i in found] == [(0, "const/16", 42), (2, "return", None)]
    assert "0000: const/16 v0, #42" in BC.listing(dex, method)


def test_members_values_and_annotations():
    dex = Dex(B.navigation())
    by = {c.id: c for c in dex.classes}
    assert by["sample.Sub"].superclass == "Lsample/Target;" and by["sample.Real"].interfaces == ["Lsample/Api;"]
    assert by["sample.Target"].fields[0].value == ("string", "config_key")
    notes = {n.type: n for n in by["sample.Api"].annotations}
    assert notes["Lhttp/Path;"].owner_kind == "parameter" and notes["Lhttp/Path;"].parameter == 0
    values = [x for n, v in notes["Lkotlin/Metadata;"].elements for x in flat_values(v, n)]
    assert ("d2[1]", "string", "fetchUser") in values and ("k", "int", "-1") in values and ("x.on", "boolean", "true") in values
    through = next(m for m in by["sample.Caller"].methods if m.name == "through")
    assert through.code.tries == [(1, 4, [("Ljava/lang/Exception;", 4), (None, 4)])]


@pytest.mark.parametrize("cut", [0, 50, 111, 113, 200, 400])
def test_damaged_files_are_errors(cut):
    with pytest.raises(DexError):
        Dex(B.navigation()[:cut])


def test_strings_are_read_without_loss():
    for text in ("a\0b", "漢字😀", "plain"):
        assert modified_utf8(B.mutf8(text)) == text
    assert modified_utf8(b"\xed\xa0\x80") == "\\ud800"


def test_every_opcode_has_a_format_and_payloads_are_skipped():
    assert set(BC._FORMATS) == set(range(256))
    from lodestack.sources.dex import Code

    words = (0x002B, 4, 0, 0x000E, 0x0100, 1, 0, 0, 5, 0)
    assert [i.name for i in BC.instructions(Code(1, 0, 0, 0, words, []))] == ["packed-switch", "return-void"]
    with pytest.raises(DexError):
        list(BC.instructions(Code(1, 0, 0, 0, (0x0013,), [])))


def test_binary_xml():
    text = C.binary_xml(B.binary_xml(B.MANIFEST, {"exported": (0x01010010, True)}))
    assert 'package="sample.app"' in text and 'android:exported="true"' in text and 'android:targetSdkVersion="30"' in text
    with pytest.raises(C.ChunkError):
        C.binary_xml(b"\x03\x00\x08\x00\xff\xff\xff")


@pytest.mark.parametrize("layout", ["dense", "sparse", "offset16", "compact"])
def test_resource_tables(layout):
    values = [("string", "title", "", (3, 0), layout), ("string", "settings", "fr", (0x12, 1), layout), ("xml", "main", "", (1, 0x7F010000), layout)]
    rows = C.resource_table(B.resource_table("sample.app", 127, ["string", "layout", "xml"], values))
    got = {(r.id, r.kind, r.name, r.configuration, r.value, r.reference) for r in rows}
    assert got == {(0x7F010001, "string", "title", "", "Hello café", None), (0x7F010000, "string", "settings", "fr", "true", None), (0x7F030000, "xml", "main", "", "@0x7f010000", 0x7F010000)}


def test_containers():
    assert [n for n in ("classes.dex", "classes2.dex", "classes1.dex", "classes02.dex", "xclasses.dex") if is_dex(n)] == ["classes.dex", "classes2.dex"]
    for bad in (["/a"], ["a/../b"], ["a", "A"], ["a\\b"], [""]):
        with pytest.raises(ContainerError):
            check_names(bad)
    box = Container(B.package({"base.apk": B.app(), "extra.apk": B.app("extra"), "icon.png": b"\x89PNG\r\n\x1a\n"}), "x.apks")
    paths = {e.path for e, _ in box.entries()}
    assert {"classes.dex", "splits/extra/classes.dex", "container/icon.png"} <= paths
    for members in ({"a.apk": B.app(), "b.apk": B.app()}, {"a.apk": B.app(), "b.apk": B.app("c.config.fr")}, {"a.apk": B.app("x")}, {"a.apk": b"no"}):
        with pytest.raises(ContainerError):
            Container(B.package(members), "x.xapk")
    assert preview(b"text") == ("text", "text") and preview(b"\x89PNG\r\n\x1a\n") == ("image", "png") and preview(b"\xff\x00")[0] == "binary"
