import collections

import corpus_pipeline
import pytest
from brute import base_spans, components, contaminated
from pyspark.sql import functions as F

from lodestack.llm import chat, decontam, registry, secrets, sharding, urlfilter
from lodestack.llm import quality as quality_rules


def test_url_filter_intervals_and_edges(spark):
    at = lambda d: F.to_timestamp(F.lit(f"2024-{d} 00:00:00"))
    entries = spark.createDataFrame(
        [("l", "bad.com", "add", "block", "01-10"), ("l", "bad.com", "add", "block", "01-10"), ("l", "bad.com", "remove", "block", "03-01"), ("l", "bad.com", "add", "block", "06-01"), ("m", "ok.bad.com", "add", "allow", "01-01"), ("l", "site.org/a/b", "add", "block", "01-01"), ("l", None, "add", "block", "01-01"), ("l", "x.org", "add", "block", None)],
        "list string, key string, action string, verdict string, d string",
    ).withColumn("dated", F.to_timestamp(F.concat(F.lit("2024-"), "d")))
    captures = spark.createDataFrame(
        [(1, "http://www.BAD.com/x", "01-09"), (2, "http://bad.com:80/", "01-10"), (3, "http://u@bad.com?q", "02-29"), (4, "http://bad.com", "03-01"), (5, "http://bad.com", "12-30"), (6, "http://ok.bad.com/p", "02-01"), (7, "https://site.org/a/b/c", "02-01"), (8, "https://site.org/a/bc", "02-01"), (9, None, "02-01"), (10, "", "02-01"), (11, "mailto:x", "02-01"), (12, "http://bad.com", None), (2, "http://bad.com:80/", "01-10")],
        "page_id long, url string, d string",
    ).withColumn("fetched_at", F.to_timestamp(F.concat(F.lit("2024-"), "d"))).withColumns({"host": F.lit("x"), "key": F.lit(1), "list": F.lit(2)})
    rows = urlfilter.judge(captures, entries).collect()
    assert collections.Counter(r["page_id"] for r in rows if r["blocked"]) == {2: 2, 3: 1, 5: 1, 7: 1}
    assert [r["matched"] for r in rows if r["page_id"] == 6] == [["l:block:bad.com", "m:allow:ok.bad.com"]]
    assert len(rows) == 13
    assert not any(r["blocked"] for r in urlfilter.judge(captures, entries.limit(0)).collect())
    assert urlfilter.judge(captures.limit(0), entries).count() == 0
    assert at("01-01") is not None


def test_url_filter_far_dates_shuffled_captures_and_clashes(spark):
    at = lambda c: F.to_timestamp(F.concat(c, F.lit(" 00:00:00")))
    log = spark.createDataFrame([("l", f"h{k}.com", "add", "block", "2024-01-01") for k in range(50)] + [("l", "h7.com", "remove", None, "2050-01-01"), ("l", "h8.com", "add", "block", "2150-01-01")], "list string, key string, action string, verdict string, d string")
    log = log.withColumn("dated", at(F.col("d")))
    captures = spark.createDataFrame([(i, f"http://h{i % 100}.com/{i}", ("2023-12-31", "2024-06-01", "2100-06-01")[i % 3]) for i in range(3000)], "page_id long, url string, d string")
    captures = captures.withColumns({"fetched_at": at(F.col("d")), "_row": F.lit(1), "_url": F.lit(2), "_at": F.lit(3), "_allow": F.lit(4), "_matched": F.lit(5), "_blocked": F.lit(6)})
    rows = urlfilter.judge(captures.repartition(7), log).collect()
    assert len(rows) == 3000
    for r in rows:
        k = r["page_id"] % 100
        want = k < 50 and r["d"] != "2023-12-31" and not (k == 7 and r["d"] == "2100-06-01")
        assert r["blocked"] == want and (r["_row"], r["_url"], r["_at"], r["_allow"], r["_matched"], r["_blocked"]) == (1, 2, 3, 4, 5, 6)
    first, last = (int(x) for x in captures.agg(F.min(F.unix_seconds("fetched_at")), F.max(F.unix_seconds("fetched_at"))).first())
    spans = urlfilter.intervals(log)
    assert urlfilter.by_period(spans, first, last)[0].count() <= 4 * spans.count()


CALLS = "conv_id long, turn long, call_id string, name string, arguments string, uses array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
TOOLS = {"f": {"a": chat.Field("integer", True, 1, 5), "b": chat.Field("string", False, 1, 3)}, "g": {"on": chat.Field("boolean")}}


def linked(spark, calls, results):
    return {(r["conv_id"], r["call_id"]): r for r in chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS).withColumn("name", F.lit(1)), TOOLS).collect()}


def test_tool_calls(spark):
    calls = [
        (1, 0, "x", "f", '{"b":"é\\"", "a": 2, "z": {"k":1,"c":[1, 2]}}', []),
        (1, 2, "y", "g", '{"on": true}', ["x"]),
        (1, 4, "w", "f", '{"a": 9}', ["y", "x"]),
        (1, 4, "v", "f", '{"a": "2"}', None),
        (1, 5, "c1", "g", '{"on": false}', ["c2"]),
        (1, 6, "c2", "g", '{"on": false}', ["c1"]),
        (1, 7, "c3", "g", '{"on": false}', ["c1"]),
        (1, 8, "m", "g", '{"on": false}', ["none"]),
        (2, 0, "x", "g", "not json", []),
        (2, 0, "x2", "g", None, []),
        (2, 1, "x3", "g", "[1]", []),
        (2, 1, "x4", "h", "{}", []),
        (2, 1, None, "g", '{"on": true}', []),
        (1, 9, "x", "g", '{"on": true}', []),
    ]
    results = [(1, 1, "x", "late\nline"), (1, 3, "x", "later"), (1, 0, "y", "before its call"), (2, 5, "x", None), (3, 5, "x", "other talk"), (1, 9, None, "n")]
    got = linked(spark, calls, results)
    assert len(got) == 12
    assert got[1, "x"]["json"] == '{"arguments":{"a":2,"b":"é\\"","z":{"c":[1,2],"k":1}},"id":"x","name":"f","result":"late\\nline"}'
    assert [got[1, c]["depth"] for c in ("x", "y", "w", "v")] == [0, 1, 2, 0]
    assert [got[1, c]["valid"] for c in ("x", "y", "w", "v")] == [True, True, False, False]
    assert [got[1, c]["depth"] for c in ("c1", "c2", "c3", "m")] == [None] * 4
    assert not any(got[2, c]["valid"] for c in ("x", "x2", "x3", "x4"))
    assert not got[1, "y"]["linked"] and got[2, "x"]["linked"] and got[2, "x"]["json"].endswith('"result":null}')
    assert linked(spark, [], []) == {}


def test_schemas_of_every_kind(spark):
    Field = chat.Field
    tools = {
        "t": {
            "n": Field("number", False, 0.5, 2),
            "e": Field("string", False, choices=("on", "off")),
            "l": Field("array", False, 1, 2, items=Field("integer", True, 1)),
            "o": Field("object", False, fields={"a b": Field("string"), "deep": Field("object", False, fields={"x": Field("boolean")})}),
            "m": Field("array", False, items=Field("array", items=Field("string", most=2))),
        }
    }
    good = ['{}', '{"n": 1}', '{"n": 0.5}', '{"n": 1.25e0}', '{"e": "on"}', '{"l": [1]}', '{"l": [1, 2], "further": [null]}', '{"o": {"a b": ""}}', '{"o": {"a b": "x", "deep": {"x": true}}}', '{"m": []}', '{"m": [[], ["a", "bc"]]}']
    bad = ['{"n": "1"}', '{"n": 2.5}', '{"n": null}', '{"e": "On"}', '{"e": 1}', '{"l": []}', '{"l": [0]}', '{"l": [1, "2"]}', '{"l": [1, 2, 3]}', '{"l": {"0": 1}}', '{"o": {}}', '{"o": []}', '{"o": {"a b": "x", "deep": {}}}', '{"o": {"a b": "x", "deep": {"x": 1}}}', '{"m": [["abc"]]}', '{"m": ["a"]}', '[]', '"t"', '{"l": [null]}']
    calls = [(1, k, f"c{k}", "t", text, []) for k, text in enumerate(good + bad)]
    frame = spark.createDataFrame(calls, CALLS).withColumns({"depth": F.lit("x"), "used": F.lit(1), "answer": F.lit(2), "c": F.lit(3), "valid": F.lit(4)})
    rows = chat.link(frame, spark.createDataFrame([], RESULTS).withColumn("answer_turn", F.lit(0)), tools).collect()
    assert {r["turn"] for r in rows if r["valid"]} == set(range(len(good)))


def check_whole_texts(rows, talk):
    """Each call holds its message, and each linked one the answer's, to the last character."""
    import json

    texts = {(r["conv_id"], r["turn"], r["role"]): r["text"] for r in talk}
    assert len(rows) == sum(r["role"] == "assistant" for r in talk)
    for r in rows:
        text, made = texts[r["conv_id"], r["turn"], "assistant"], json.loads(r["json"])
        assert json.dumps(made, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["json"]
        assert made["arguments"] == {"query": text, "pinned": len(text) % 2 == 0, "limit": len(text) % 10}
        answer = texts.get((r["conv_id"], r["turn"] + 1, "user"))
        assert made["result"] == answer and r["linked"] == (answer is not None)
        n = len(text)
        fits = [8 <= n <= 2000 and 1 <= n % 10, 1 <= n <= 500, n >= 1, False][n % 4]
        assert r["valid"] == (fits and r["depth"] is not None)


def test_tool_calls_carry_whole_texts(spark, small, tmp_path):
    talk = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    check_whole_texts(registry.op4_tool_calls(spark, small).collect(), talk)
    odd = [(1, 0, "assistant", 'é "quoted" \\ back\nline ' + "x" * 400 + " 7 end"), (1, 1, "user", 'ñ\t"{}" ' + "y" * 900 + "!"), (1, 2, "assistant", "short"), (2, 0, "assistant", "日本" * 30)]
    spark.createDataFrame(odd, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = registry.op4_tool_calls(spark, str(tmp_path)).collect()
    check_whole_texts(rows, spark.read.parquet(str(tmp_path / "conversations.parquet")).collect())
    text = registry.op4_tool_calls(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_sharding_table():
    names = [f"s{k}" for k in range(10)]
    table = sharding.lookup(names, 1009)
    share = collections.Counter(table)
    assert max(share.values()) - min(share.values()) <= 1
    assert sharding.lookup(names[::-1], 1009) == table
    less = sharding.lookup(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, less, strict=True) if a != "s9")
    assert moved < 0.2 * 1009
    for bad in ([], names):
        with pytest.raises(ValueError):
            sharding.lookup(bad, 1008)


def test_sharding_places(spark, small):
    import hashlib

    table = sharding.lookup(registry.SHARDS)
    rows = registry.op9_sharding(spark, small).collect()
    assert len(rows) == 200
    for r in rows:
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    edge = spark.createDataFrame([(None, 1), ("", 2), ("a", 3), ("a", 4)], "k string, slot int")
    got = sharding.place(edge, "k", ["x", "y"]).collect()
    assert got[0]["slot"] == got[1]["slot"] and got[2]["shard"] == got[3]["shard"] and len(got) == 4
    assert sharding.place(edge.limit(0), "k", ["x"]).count() == 0


def test_sharded_files(spark, tmp_path):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    sharding.write(df, "k", ["x", "y", "z"], str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and back.select("shard").distinct().count() == 3


def test_queries_match_their_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("pages", "conversations", "documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{small}/{name}.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        df = registry.QUERIES[name](spark, small)
        columns = sorted(df.columns)
        want = con.sql(sql)
        got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
        assert got == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr), name


def test_pipeline_against_brute_force(spark, small):
    import pyarrow as pa

    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    keep = quality_rules.passes(pa.array([r["text"] for r in rows], pa.large_string()), list(quality_rules.BASE + quality_rules.VERDICT))
    docs = {r["doc_id"]: r for r, ok in zip(rows, keep.tolist(), strict=True) if ok}
    classes = components([(i, r["text"]) for i, r in docs.items()])
    docs = {i: r for i, r in docs.items() if classes[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = {i: r for i, r in docs.items() if not contaminated(r["text"], items)[1]}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(out) == set(docs)
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = registry.vocabulary()
    reference = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    plain = 0
    for i, r in out.items():
        assert r["n_tokens"] == len(r["ids"])
        text = reference.decode(r["ids"])
        assert r["ids"] == reference.encode_ordinary(text)
        if not base_spans(docs[i]["text"]):
            plain += 1
            assert text == docs[i]["text"]
        else:
            assert "[secret]" in text
    assert plain


def test_pipeline_stages_take_edges(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x" * 30_000, "en", "s", 30_000), (3, "x" * 30_000, "en", "s", 30_000), (None, "one two three four five six seven eight nine ten eleven", None, "s", 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, small)
            assert out.count() <= docs.count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns


def test_null_and_repeated_ids_are_cleaned_and_redacted(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    secret = "key ghp_9aZ8bY7cX6dW5eV4fU3g here"
    rows = [(None, f"so {passage} it is", "a", 1), (None, "a clean text", "a", 2), (4, f"so {passage}", "a", 3), (4, "another clean text", "a", 4), (None, secret, "a", 5), (6, f"{secret} and more", "a", 6), (6, "api_key is not told, nor is any other", "a", 7), (6, "password=Zq8Lr5Tn2Vb7", "b", 8), (None, None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").withColumn("n_chars", F.length("text").cast("long"))
    assert {r["n"] for r in decontam.clean_documents(docs, bench).collect()} == {2, 4, 5, 6, 7, 8, 9}
    clashing = docs.withColumns({c: F.lit(c) for c in ("_cuts", "_row", "_found", "row_id", "kind", "spans", "_hit", "_digest")})
    assert secrets.redact(clashing).columns == clashing.columns and decontam.clean_documents(clashing, bench).columns == clashing.columns
    assert {r["n"] for r in decontam.clean_documents(clashing, bench).collect()} == {2, 4, 5, 6, 7, 8, 9}
    texts = {r["n"]: (r["text"], r["n_chars"]) for r in secrets.redact(clashing).collect()}
    want = {n: t for _, t, _, n in rows} | {5: "key [secret] here", 6: "key [secret] here and more", 8: "[secret]"}
    assert texts == {n: (t, None if t is None else len(t)) for n, t in want.items()}
