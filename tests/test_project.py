import build as B
import pytest
from pyspark.sql import functions as F

from lodestack.functions import plugins as U
from lodestack.operators.paging import ContractError
from lodestack.project import Project
from lodestack.sources import datasource
from lodestack.sources.container import ContainerError
from lodestack.sources.facts import SCHEMAS, Facts, fact_batch
from lodestack.streaming import jobs


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("apps")
    (folder / "app.apks").write_bytes(B.package({"base.apk": B.app(), "extra.apk": B.app("extra")}))
    return Project.open(spark, str(folder))


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()), key=repr)


RUN = "sample.Target.run(Ljava/lang/String;I)V"


def test_lists(project):
    assert values(project.get_all_classes(), "class_id") == ["sample.Api", "sample.Boot", "sample.Caller", "sample.Case", "sample.Hello", "sample.Real", "sample.Sub", "sample.Target"]
    assert values(project.get_all_classes("ca", case_sensitive=False), "class_id") == ["sample.Caller", "sample.Case"]
    assert values(project.get_all_classes(package_prefix="sample.Ca"), "class_id") == []
    assert values(project.get_methods_of_class("sample.Target"), "name") == ["only", "run"]
    assert values(project.get_fields_of_class("sample.Case"), "field_id") == ["sample.Case.id:I"]
    assert "splits/extra/assets/extra.txt" in values(project.get_all_resource_file_names("assets"), "path")
    assert "fetchUser" in values(project.get_dex_strings("sample.Api"), "value") and values(project.get_dex_strings("sample.Hello", "fetch"), "value") == []
    assert project.facts.complete


def test_search(project):
    hits = project.search_code("config_key").collect()
    assert [(h["method_id"], h["matched"]) for h in hits] == [("sample.Caller.call()V", "config_key")]
    assert sorted(values(project.search_code("beta", scope="resources"), "start")) == [6, 11]
    assert values(project.search_identifiers("run", "exact", projection="callers"), "owner", "matching_occurrences") == sorted([(None, 2), ("sample.Caller.call()V", 1), ("sample.Caller.through(Ljava/lang/String;)V", 1)], key=repr)
    assert values(project.find_string_references("config_key", "exact"), "context") == ["code", "static_value"]
    assert values(project.find_string_references("users"), "context") == ["annotation"]
    assert values(project.find_integer_references([42]), "method_id", "pc") == [("sample.Hello.answer()I", 0)]
    rows, totals = project.find_field_references("Lsample/Case;->id:I", "write")
    assert values(rows, "method_id") == ["sample.Case.<init>(I)V"] and values(totals, "reads", "writes") == [(1, 1)]
    assert values(project.find_instantiations("sample.Case"), "method_id") == ["sample.Caller.make()V"]
    assert values(project.find_type_references("sample.Target"), "owner") == ["sample.Caller.call()V"]
    assert values(project.find_annotation_usages("GET", match_mode="simple_name"), "owner") == ["sample.Api.get(Ljava/lang/String;)V"]
    assert values(project.find_annotation_usages("Lhttp/Path;", "value"), "value") == ["id"]
    assert values(project.search_kotlin_metadata("fetch"), "path", "value") == [("d2[1]", "fetchUser")]
    assert values(project.search_assets("beta"), "path", "n_matches") == [("assets/notes.txt", 2)]


def test_hierarchy_and_graph(project):
    assert values(project.find_direct_subclasses("sample.Target"), "class_id") == ["sample.Sub"]
    assert values(project.find_implementations("sample.Api"), "class_id") == ["sample.Real"]
    assert values(project.get_class_hierarchy("sample.Sub"), "parent", "loaded") == [("sample.Target", True)]
    callers = project.get_call_graph(RUN, "callers", 3)
    assert values(callers, "node", "depth") == [("sample.Caller.call()V", 1), (RUN, 0)]
    more = project.get_call_graph([RUN, "sample.Sub.run(Ljava/lang/String;I)V"], "callers", 3, dispatch=True)
    assert ("sample.Sub.run(Ljava/lang/String;I)V", "sample.Caller.call()V") in values(more, "root", "node")
    with pytest.raises(ContractError):
        project.get_call_graph(RUN, depth=101)
    assert values(project.resolve_method("sample.Sub.only"), "method_id") == ["sample.Target.only()V"]
    assert values(project.resolve_method("Lsample/Sub;->run(Ljava/lang/String;I)V"), "class_id") == ["sample.Sub"]


def test_evidence(project):
    found = project.constant_arguments(RUN)
    assert values(found, "argument", "kind", "value") == [(0, "string", "config_key"), (1, "bits", "7")]
    assert values(project.find_config_key_consumers("config_key"), "callee") == [RUN]
    sites = project.get_call_sites("sample.Sub.run(Ljava/lang/String;I)V", argument=0, literal="x")
    assert values(sites, "verdict") == ["unresolved"]
    assert values(project.get_call_sites(RUN, argument=0, literal="x"), "verdict") == ["excluded"]
    assert values(project.get_lambda_branch("sample.Case.id:I"), "method_id", "value") == [("sample.Case.invoke()V", 3)]
    assert values(project.resolve_switch_case_callers("sample.Case", 3), "method_id", "verdict") == [("sample.Caller.make()V", "matched")]
    assert values(project.resolve_switch_case_callers("sample.Case", 4), "verdict") == ["excluded"]
    assert values(project.find_network_stacks("services"), "verb", "route", "status") == [("GET", "/users/{id}", "proven")]
    assert project.find_webview_chooser_flows().count() == 0
    assert "sample.Caller" not in values(project.find_forwarders(), "method_id")


def test_resources_and_manifest(project):
    assert values(project.get_manifest_components(), "kind", "name", "exported", "launcher") == [("activity", "sample.app.Main", True, True), ("service", "sample.Target", False, False)]
    assert values(project.find_routes(host="example.com", scheme="https"), "name", "relaxation") == [("sample.app.Main", "folded")]
    assert values(project.find_routes(host="ample", path="/open"), "relaxation") == ["host: contains"]
    assert values(project.get_manifest_summary("counts"), "kind", "total") == sorted([(None, 2), ("activity", 1), ("service", 1)], key=repr)
    assert values(project.get_strings("café"), "value") == ["Hello café"]
    chain = project.get_resource_value(resource_name="sample.app:string/alias").collect()
    assert [(r["value"], r["status"], r["resolved_id"]) for r in chain] == [("@0x7f010001", "resolved", 0x7F010001)]
    assert values(project.list_nav_deeplinks(), "destination", "uri") == [("@id/home", "app://home/{id}")]
    assert values(project.find_layout_references(), "reference", "kind") == [(".Main", "context"), ("@layout/bar", "include"), ("sample.Part", "fragment"), ("sample.Widget", "view")]
    page = project.get_android_manifest(0, 10).collect()[0]
    assert page["page"] == '<?xml vers' and page["next_offset"] == 10
    assert values(project.exposure(), "node", "exposed")[:1] == [("java.lang.Object", False)]


def test_sources(project):
    page = project.get_method_source("sample.Caller#call()V").collect()[0]
    assert "invoke-virtual v0, v1, v2, " + RUN in page["page"]
    hit = project.resolve_reference("sample.Caller.call()V", page["sha256"], 6).collect()
    assert [(h["pool"], h["operand"]) for h in hit] == [("method", RUN)]
    with pytest.raises(Exception, match="SOURCE_CHANGED"):
        project.resolve_reference("sample.Caller.call()V", "0", 6).collect()
    assert project.get_class_disassembly("sample.Caller").collect()[0]["text"].count(".end method") == 3


def test_failures_and_duplicates(spark, tmp_path):
    (tmp_path / "bad.apk").write_bytes(b"nothing")
    (tmp_path / "cut.apk").write_bytes(B.package({"classes.dex": B.navigation()[:300], "assets/a.txt": b"x"}))
    facts = Facts(spark, str(tmp_path))
    assert not facts.complete and sorted(r["part"] for r in facts.table("failure").collect()) == ["container", "dex"]
    assert facts.table("archive_entry").count() == 2
    (tmp_path / "a.dex").write_bytes(B.hello())
    (tmp_path / "b.dex").write_bytes(B.hello())
    with pytest.raises(ContainerError, match="DUPLICATE_CLASS"):
        Facts(spark, str(tmp_path))


def test_packages_with_members_of_one_name(spark, tmp_path):
    for folder, dex in (("x", B.navigation()), ("y", B.hello())):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "app.apk").write_bytes(B.package({"classes.dex": dex}))
    both = Project.open(spark, str(tmp_path))
    pool = lambda c: set(values(both.get_dex_strings(c), "value"))
    assert "fetchUser" in pool("sample.Api") and "fetchUser" not in pool("sample.Hello") and pool("sample.Hello")


def test_facts_hold_any_name(spark):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL("file string, fact string").add("dex_string", StructType.fromDDL(SCHEMAS["dex_string"])).add("document", StructType.fromDDL(SCHEMAS["document"])))
    rows = [dict(dex_id="a", idx=0, value="x\ud800y"), dict(dex_id="a", idx=1, value="é\U0001f600")]
    made = fact_batch("f", "dex_string", rows, schema)
    assert [r["value"] for r in made.column("dex_string").to_pylist()] == ["x?y", "é\U0001f600"]
    assert made.column("document").null_count == 2 and made.column("file").to_pylist() == ["f", "f"]


def test_data_source(spark, tmp_path):
    (tmp_path / "a.dex").write_bytes(B.navigation())
    (tmp_path / "b.dex").write_bytes(B.hello())
    datasource.register(spark)
    load = lambda t: spark.read.format("package_facts").option("table", t).load(str(tmp_path))
    assert load("dex_class").count() == 8
    assert values(load("dex_method").where(F.col("class_id") == "sample.Hello"), "method_id") == ["sample.Hello.answer()I"]


def test_save(project, tmp_path):
    project.facts.save(str(tmp_path / "out"))
    assert project.spark.read.parquet(str(tmp_path / "out" / "dex_class")).count() == 8


def test_export_resumes_and_verifies(project, tmp_path):
    path = f"file://{tmp_path}/job"
    make = lambda: jobs.export_job(project.spark, path, project.table("listing"), chunks=4)
    job = make()
    job.start()
    part = job.run(most=2)
    assert part.state == "running" and part.done == 2 and not part.scan_complete
    again = make()
    again.start(resume=True)
    done = again.run()
    assert done.state == "complete" and done.coverage_complete and done.rows == project.table("listing").count()
    assert jobs.verify(again).count() == 0
    for resume, code in ((False, "EXISTS"), (True, "COMPLETE")):
        with pytest.raises(jobs.JobError, match=code):
            make().start(resume=resume)
    with pytest.raises(jobs.JobError, match="OTHER_JOB"):
        other = jobs.export_job(project.spark, path, project.table("listing").limit(1), chunks=4)
        other.start(resume=True)


def test_search_job_cancels(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    job = jobs.search_job(spark, f"file://{tmp_path}/s", docs, "doc_id", "text", "the", chunks=3)
    job.start()
    job.run(most=1)
    job.cancel()
    assert job.run().state == "cancelled" and job.status().done == 1
    job.start(resume=True)
    assert job.run().state == "complete"
    from lodestack.operators.search import matches

    assert job.results().count() == matches(docs, "doc_id", "text", "the").count()
    job.release()
    assert not job.store.exists()


def test_stream_equals_batch(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    source = str(tmp_path / "in")
    args = (spark, source, "doc_id long, text string", "doc_id", "text", "the", str(tmp_path / "out"), str(tmp_path / "check"))
    total = 0
    for part in docs.randomSplit([0.5, 0.5], 3):
        part.write.mode("append").parquet(source)
        jobs.stream_matches(*args).awaitTermination(120)
        from lodestack.operators.search import matches

        total += matches(part, "doc_id", "text", "the").count()
        assert spark.read.parquet(str(tmp_path / "out")).count() == total


def test_plugins(project, monkeypatch):
    text = '{"id": "a.b", "name": "n", "version": "1", "protocol": 2, "capability": "project.analyze", "tools": ["search_code"]}'
    manifest = U.Manifest.load(text)
    found = U.analyze_project(project, manifest, lambda host: [{"n": len(host.query("search_code", query="config_key"))}], "n long")
    assert values(found, "n") == [1]
    with pytest.raises(U.PluginError):
        U.Host(project, manifest).query("get_call_graph", method_id=RUN)
    # A callback gives every row, page by page, or an error: never a part.
    monkeypatch.setattr(U, "ROWS_MOST", 3)
    many = project.search_code("const").count()
    assert many > 6 and len(U.Host(project, manifest).query("search_code", query="const")) == many
    rows, total = U.Host(project, manifest).page("search_code", 3, query="const")
    assert len(rows) == 3 and total == many
    monkeypatch.setattr(U, "QUERIES_MOST", 2)
    with pytest.raises(U.PluginError):
        U.Host(project, manifest).query("search_code", query="const")
    monkeypatch.undo()
    for bad in ("[]", "{", text.replace('"tools"', '"tool"'), text.replace("search_code", "open_apk"), text.replace("2", "1"), text.replace('"a.b"', '"A B"')):
        with pytest.raises(U.PluginError):
            U.Manifest.load(bad)
    stats = U.analyze_sources(project.table("listing"), "method_id", "text", U.source_statistics)
    assert stats.where("error is not null").count() == 0
    broken = U.analyze_sources(project.table("listing"), "method_id", "text", lambda t: 1 / 0)
    assert broken.where("error like 'ZeroDivisionError%'").count() == stats.count()
    assert U.source_statistics("class Hello { // α😀\n}\n") == {"lines": 2, "characters": 22}
    assert U.analyze_project(project, manifest, U.webview_inventory, "method_id string, call string, line long").count() == 0


def test_control_flow(project):
    from lodestack.operators import cfg

    own = project.bodies.where("method_id = 'sample.Case.invoke()V'")
    blocks = {r["block"]: (r["first_pc"], r["last_pc"], r["dominator"], r["live"]) for r in cfg.cfg_blocks(own).collect()}
    assert blocks == {0: (0, 3, None, [2]), 1: (5, 5, 0, []), 2: (6, 6, 0, [])}
    assert values(cfg.cfg_edges(own), "source", "target") == [(0, 1), (0, 2), (1, 2)]


def test_registry(spark, tmp_path):
    from lodestack.registry import Registry

    (tmp_path / "a.apk").write_bytes(B.app())
    registry = Registry(spark)
    one = registry.open_apk(str(tmp_path))
    assert registry.open_apk(str(tmp_path)) is one
    info = registry.get_instance_info(one.id)
    assert info["classes"] == 7 and info["complete"] and info["has_manifest"]
    assert registry.get_health() == [{"instance_id": one.id, "ready": True, "failures": 0}]
    assert registry.list_instances(package="sample").count() == 1 and registry.list_instances(package="no").count() == 0
    registry.forget_instance(one.id)
    with pytest.raises(ContractError):
        registry.get(one.id)


def test_exports(project, tmp_path):
    from lodestack import exports

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.apk").write_bytes(B.app())
    out = f"file://{tmp_path}/one"
    assert exports.export_source(project, out, class_name="sample.Caller")["complete"]
    with pytest.raises(ContractError, match="EXISTS"):
        exports.export_source(project, out, class_name="sample.Caller")
    with pytest.raises(ContractError):
        exports.export_source(project, f"{out}2")
    asset = exports.export_asset(project, str(tmp_path / "in"), "assets/notes.txt").collect()
    assert [bytes(r["content"]) for r in asset] == [b"alpha beta\nbeta\n"]
    assert exports.main([str(tmp_path / "in"), f"file://{tmp_path}/all", "--prefix", "sample"]) == 0
    assert exports.main([str(tmp_path / "in"), f"file://{tmp_path}/all", "--prefix", "sample"]) == 1


def test_more_lookups(project):
    from lodestack.functions import names as N
    from lodestack.operators import search as Q

    nodes = project.get_call_graph(RUN, "callers", 3)
    assert values(project.filter_nodes(nodes, class_name="sample.Other"), "node") == [RUN]
    assert values(project.filter_nodes(nodes, package_prefix="sample"), "node") == ["sample.Caller.call()V", RUN]
    assert values(project.filter_nodes(nodes, annotation="GET", component_type="activity"), "node") == [RUN]
    lines = project.enrich_sites(project.get_call_sites(RUN)).collect()
    assert [RUN in r["text"] and r["line"] == 6 for r in lines] == [True]
    assert values(project.semantic_edges(), "source", "kind") == [("sample.Api.get(Ljava/lang/String;)V", "possible_interface_dispatch"), (RUN, "possible_virtual_dispatch")]
    assert values(project.services_outside("other"), "inside", "outside") == [(0, 1)]
    assert project.bundle_reads().count() == 0
    assert values(project.search_definitions("answer"), "symbol", "kind") == [("sample.Hello.answer()I", "method")]
    assert values(project.resource_aliases("R.string.title"), "hex") == ["0x7f010001"]
    assert N.java_literal('a"é\n😀') == '"a\\"\\u00e9\\n\\ud83d\\ude00"'
    docs = project.spark.createDataFrame([("d", "ab\n\nc😀\n")], "k string, t string")
    assert values(Q.line_offsets(docs, "k", "t"), "line", "start", "end") == [(1, 0, 2), (2, 3, 3), (3, 4, 6), (4, 7, 7)]


def test_class_sources(project):
    from lodestack.operators import render

    page = project.get_class_source("sample.Target").collect()[0]
    text = page["page"]
    assert text.startswith("package sample;\n\npublic class Target {\n") and 'public static String NAME = "config_key";'.replace("String", "java.lang.String") in text
    assert "public void run(java.lang.String p0, int p1) {" in text and "0000: return-void" in text
    assert (page["methods"], page["dex_fallback"], page["omitted"]) == (2, 2, 0)
    assert "public interface Api {" in project.get_class_source("sample.Api").collect()[0]["page"]
    assert "public class Real implements sample.Api {" in project.get_class_source("sample.Real").collect()[0]["page"]
    assert project.class_sources().count() == 8
    names = values(render.definitions(project.class_sources().where("class_id = 'sample.Target'")), "name")
    assert names == ["NAME", "only", "run"] or set(names) >= {"NAME"}
    assert values(project.find_usages(RUN), "owner") == ["sample.Caller.call()V"]


def test_creations_and_resources(project):
    assert values(project.service_creations(), "method_id", "service", "base_url") == [("sample.Boot.start()V", "sample.Api", None)]
    assert values(project.resource_arguments(), "method_id", "kind", "name") == [("sample.Boot.start()V", "layout", "main")]
    assert values(project.list_annotation_deeplinks(), "class_id", "uri") == [("sample.Boot", "app://boot")]
    used = project.find_network_stacks()
    assert ("sample.Boot", "retrofit", "api_usage") in values(used, "class_id", "detail", "evidence")
    assert values(project.cross_namespace_calls(), "method_id") == ["sample.Boot.start()V"] * 2
