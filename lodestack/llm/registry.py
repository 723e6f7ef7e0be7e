"""Queries of the training-data operators and, where SQL can state them, their DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of a public tokenizer, read on the driver."""
    import public_tokenizers

    from .bpe import read_ranks

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    ranks, pattern = vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, ranks, pattern, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.assess(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against dated lists of hosts and host paths.

    `pages` has no fetch times and no lists, so both are derived: a page is fetched page_id days (of 366) after the
    start of 2024, and a third of all hosts and host paths come on and off a list by digits of their MD5.
    """
    from . import urlfilter

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda n: F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit("2024-01-01 00:00:00"))) + n * 86_400)
    captures = pages.withColumn("fetched_at", day(F.col("page_id") % 366))
    keys = pages.select(F.explode(urlfilter.keys_of(F.col("url"))).alias("key")).where("size(split(key, '[.]')) > 2").distinct()
    digit = lambda at, n: F.conv(F.substring(F.md5(F.col("key").cast("binary")), at, n), 16, 10).cast("long")
    keys = keys.select("key", digit(1, 4).alias("h"), (digit(5, 4) % 300).alias("d")).where("h % 3 = 0")
    verdict = F.when(F.col("h") % 15 == 0, "allow").otherwise("block")
    log = keys.select("key", F.lit("main").alias("list"), verdict.alias("verdict"), F.col("h"), F.col("d"))
    events = F.array(
        F.struct(F.lit("add").alias("action"), F.col("d").alias("on")),
        F.struct(F.when(F.col("h") % 2 == 0, F.lit("remove")).alias("action"), (F.col("d") + 30).alias("on")),
        F.struct(F.when(F.col("h") % 4 == 0, F.lit("add")).alias("action"), (F.col("d") + 60).alias("on")),
    )
    entries = log.select("list", "key", "verdict", F.explode(events).alias("e")).select("list", "key", "verdict", "e.action", day(F.col("e.on")).alias("dated"))
    judged = urlfilter.judge(captures, entries)
    return judged.select("page_id", "host", "blocked", F.size("matched").cast("long").alias("n_matched"), F.array_join("matched", ",").alias("matched"))


OP3_SQL = """
WITH p AS (
  SELECT page_id, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(page_id % 366 AS INTEGER)) AS fetched,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1) AS host,
    [x FOR x IN string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/') IF x <> ''] AS parts
  FROM pages),
k AS (
  SELECT DISTINCT page_id, fetched, unnest(list_concat(
    [array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, len(string_split(host, '.')) + 1)],
    [host || '/' || array_to_string(parts[1:i], '/') FOR i IN range(1, len(parts) + 1)])) AS key
  FROM p WHERE host <> ''),
h AS (
  SELECT DISTINCT key, CAST('0x' || substr(md5(key), 1, 4) AS BIGINT) AS h, CAST('0x' || substr(md5(key), 5, 4) AS BIGINT) % 300 AS d
  FROM k WHERE len(string_split(key, '.')) > 2),
e AS (
  SELECT key, h, 'add' AS action, d AS day FROM h WHERE h % 3 = 0
  UNION ALL SELECT key, h, 'remove', d + 30 FROM h WHERE h % 3 = 0 AND h % 2 = 0
  UNION ALL SELECT key, h, 'add', d + 60 FROM h WHERE h % 3 = 0 AND h % 4 = 0),
s AS (
  SELECT key, CASE WHEN h % 15 = 0 THEN 'allow' ELSE 'block' END AS verdict, action,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(day AS INTEGER)) AS f,
    lead(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(day AS INTEGER))) OVER (PARTITION BY key ORDER BY day) AS t
  FROM e),
m AS (
  SELECT page_id, verdict, 'main:' || verdict || ':' || s.key AS entry
  FROM k JOIN s ON k.key = s.key AND s.action = 'add' AND fetched >= f AND (t IS NULL OR fetched < t)),
g AS (
  SELECT page_id, string_agg(entry, ',' ORDER BY encode(entry)) AS matched, count(*) AS n, max(CASE verdict WHEN 'allow' THEN 1 ELSE 0 END) AS a, max(CASE verdict WHEN 'block' THEN 1 ELSE 0 END) AS b
  FROM m GROUP BY page_id)
SELECT p.page_id, p.host, coalesce(b = 1 AND a = 0, false) AS blocked, coalesce(n, 0) AS n_matched, coalesce(matched, '') AS matched
FROM p LEFT JOIN g ON p.page_id = g.page_id
"""


def _call_id(turn: Column) -> Column:
    return F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")).cast("binary"))


def _derived_calls(talk: DataFrame, arguments: Column, content: Column) -> DataFrame:
    """Every assistant message as a call with `arguments`, every user message after one as its result, linked."""
    from . import chat

    size = F.length("text")
    tool = F.when(size % 4 == 0, "search").when(size % 4 == 1, "lookup").when(size % 4 == 2, "note").otherwise("paint")
    uses = F.when((size % 3 == 0) & (F.col("turn") >= 2), F.array(_call_id(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = talk.where("role = 'assistant'").select("conv_id", "turn", _call_id(F.col("turn")).alias("call_id"), tool.alias("name"), arguments.alias("arguments"), uses.alias("uses"))
    results = talk.where("role = 'user'").select("conv_id", "turn", _call_id(F.col("turn") - 1).alias("call_id"), content.alias("content"))
    schemas = {
        "search": {"query": chat.Field("string", True, 8, 2_000), "limit": chat.Field("integer", True, 1, 9)},
        "lookup": {"query": chat.Field("string", True, 1, 500), "region": chat.Field("string", False)},
        "note": {"query": chat.Field("string", True, 1), "pinned": chat.Field("boolean")},
    }
    return chat.link(calls, results, schemas)


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant message as a call, every user message after one as its result.

    `conversations` has no calls, so they are derived: the identifier from conversation and turn, the tool from the
    text's length; every third message uses the call two turns before.  Arguments and results carry whole texts as they
    are, JSON-escaped, never cut or stripped; a null text has arguments null.
    """
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    size = F.length("text")
    members = F.struct(F.col("text").alias("query"), (size % 2 == 0).alias("pinned"), (size % 10).alias("limit"))
    return _derived_calls(talk, F.when(F.col("text").isNotNull(), F.to_json(members)), F.col("text"))


OP4_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, length(text) AS n, text FROM conversations),
c AS (
  SELECT conv_id, turn, md5(concat(conv_id, ':', turn)) AS call_id,
    CASE n % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' WHEN 2 THEN 'note' ELSE 'paint' END AS name,
    text AS query, n, n % 2 = 0 AS pinned, n % 10 AS lim, CASE WHEN n % 3 = 0 AND turn >= 2 THEN turn - 2 END AS used
  FROM t WHERE role = 'assistant'),
o AS (
  SELECT conv_id, turn, 0 AS depth FROM c WHERE used IS NULL
  UNION SELECT c.conv_id, c.turn, o.depth + 1 FROM o JOIN c ON c.conv_id = o.conv_id AND c.used = o.turn),
r AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content FROM t WHERE role = 'user' GROUP BY 1, 2)
SELECT c.conv_id, c.turn, c.call_id, o.depth,
  coalesce(o.depth IS NOT NULL AND CASE name WHEN 'search' THEN n BETWEEN 8 AND 2000 AND lim BETWEEN 1 AND 9
    WHEN 'lookup' THEN n BETWEEN 1 AND 500 WHEN 'note' THEN n >= 1 ELSE false END, false) AS valid,
  r.conv_id IS NOT NULL AS linked,
  '{"arguments":{"limit":' || lim || ',"pinned":' || pinned || ',"query":' || to_json(query) || '},"id":"' || call_id || '","name":"' || name || '","result":' || coalesce(to_json(content), 'null') || '}' AS json
FROM c LEFT JOIN o ON o.conv_id = c.conv_id AND o.turn = c.turn LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn
"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    found = secrets.scan(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(secrets.rendered(base), 256).alias("base_sha256"),
        secrets.rendered(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(*langid.sample(docs, ~held_out))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


#: Shards of op9.
SHARDS = [f"shard-{k:03d}" for k in range(97)]


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    found = licenses.scan(table(spark, sf_dir, "documents"))
    starts, labels = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["label"])
    best = F.array_max(F.transform("met", lambda m: m["containment"]))
    join = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        join(labels).alias("base_labels"),
        join(F.concat(labels, F.transform("met", lambda m: m["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


QUERIES = {
    f.__name__: f
    for f in (op1_bpe, op2_decontaminate, op3_url_filter, op4_tool_calls, op5_near_duplicates, op6_quality, op7_secrets, op8_language, op9_sharding, op10_licenses)
}
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM s)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM s) WHERE len(w) >= k)),
h AS (SELECT DISTINCT doc_id, item_id, dw.k, i FROM dw JOIN bw ON dw.k = bw.k AND dw.x = bw.x),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 75 * (na.n + nb.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS id, a AS goal FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.goal),
c AS (SELECT id, min(goal) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(low, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS k FROM g) WHERE k > 1) GROUP BY 1),
c AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_doubled
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 10 * n_digits > 6 * word_chars OR 10 * n_doubled > 3 * n_words
    OR (n_lines >= 4 AND 10 * n_dup_lines > 4 * n_lines)) AS kept
FROM f
"""

ORACLE_SQL = {"op2_decontaminate": OP2_SQL, "op3_url_filter": OP3_SQL, "op4_tool_calls": OP4_SQL, "op5_near_duplicates": OP5_SQL, "op6_quality": OP6_SQL}
