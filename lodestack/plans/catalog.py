"""The registered queries of the engine's own operators, each with the SQL that states the same.

Operators take any table; here they run over the given ones, whole.  Names say what the operator does.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import manifest as M
from lodestack.functions import names as N
from lodestack.functions import numbers as B
from lodestack.functions import scope as S
from lodestack.functions import text as T
from lodestack.functions import tristate as V
from lodestack.operators import aggregates as A
from lodestack.operators import graph as G
from lodestack.operators import manifest as MF
from lodestack.operators import markup as K
from lodestack.operators import paging as P
from lodestack.operators import references as R
from lodestack.operators import resources as X
from lodestack.operators import search as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Search.

_HITS = """
WITH p AS (SELECT doc_id, text, string_split(text, '{q}') AS parts FROM documents WHERE contains(text, '{q}')),
h AS (SELECT doc_id, text, i - 1 AS ordinal, CAST(length(array_to_string(parts[1:i], '{q}')) AS BIGINT) AS s
  FROM (SELECT doc_id, text, parts, unnest(range(1, len(parts))) AS i FROM p)),
l AS (SELECT *, substr(text, 1, s) AS before, substr(text, s + 1) AS rest FROM h),
c AS (SELECT *, length(before) - length(replace(before, chr(10), '')) + 1 AS line,
    length(string_split(before, chr(10))[-1]) AS col, string_split(rest, chr(10))[1] AS eol FROM l)
"""


@query(
    _HITS.format(q="heth")
    + """SELECT doc_id, ordinal, s AS start, s + 4 AS "end", line, col + 1 AS "column", 'heth' AS matched,
  CASE WHEN col > 60 THEN '…' ELSE '' END || substr(string_split(before, chr(10))[-1], greatest(col - 59, 1)) || substr(eol, 1, 180) AS preview
FROM c"""
)
def literal_search(spark, sf_dir):
    """Every occurrence of a literal with offset, line, column and preview."""
    return Q.matches(read(spark, sf_dir, "documents"), "doc_id", "text", "heth")


@query("""SELECT doc_id, CAST((length(text) - length(replace(text, 'thnd', ''))) / 4 AS BIGINT) AS n_matches FROM documents WHERE contains(text, 'thnd')""")
def literal_counts(spark, sf_dir):
    return Q.counts(read(spark, sf_dir, "documents"), "doc_id", "text", "thnd")


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)ÊAU')) AS BIGINT) AS n_matches FROM documents WHERE regexp_matches(text, '(?i)ÊAU')""")
def literal_counts_folded(spark, sf_dir):
    """Case-insensitive beyond ASCII."""
    return Q.counts(read(spark, sf_dir, "documents"), "doc_id", "text", "ÊAU", case_sensitive=False)


@query("""SELECT page_id, CAST(len(list_filter(regexp_extract_all(html, '<p>|x*'), lambda m: m <> '')) AS BIGINT) AS n_matches FROM pages
WHERE len(list_filter(regexp_extract_all(html, '<p>|x*'), lambda m: m <> '')) > 0""")
def regex_counts(spark, sf_dir):
    """A pattern that also matches nothing: empty matches do not count."""
    return Q.counts(read(spark, sf_dir, "pages"), "page_id", "html", "<p>|x*", use_regex=True)


@query("""SELECT doc_id, n_words FROM (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+'), lambda w: w = 'the')) AS BIGINT) AS n_words FROM documents) WHERE n_words > 0""")
def whole_word_occurrences(spark, sf_dir):
    """Whole words of all documents, also of those without a language; word characters are Unicode's."""
    return read(spark, sf_dir, "documents").select("doc_id", T.whole_word(F.col("text"), "the").alias("n_words")).where("n_words > 0")


@query("""SELECT * FROM (SELECT doc_id, CAST((length(text) - length(replace(text, 'reer', ''))) / 4 AS BIGINT) AS n_matches,
  row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS total, CASE WHEN count(*) OVER () > 30 THEN 30 END AS next_offset
FROM documents WHERE contains(text, 'reer')) WHERE position BETWEEN 10 AND 29""")
def paged_search(spark, sf_dir):
    """A page with its exact total and the offset of the next."""
    found = Q.counts(read(spark, sf_dir, "documents"), "doc_id", "text", "reer")
    return P.page(found, ["doc_id"], offset=10, limit=20).withColumns({"next_offset": F.col("next_offset").cast("int")})


@query("""SELECT doc_id, position FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS position FROM documents)""")
def result_positions(spark, sf_dir):
    """The place of every row in a total order, numbered range by range."""
    return P.positions(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"]).select("doc_id", "position")


@query("""SELECT count(*) AS n_records, sha256(string_agg(o_orderkey || ':' || o_orderstatus || chr(10), '' ORDER BY o_orderkey)) AS sha256 FROM orders""")
def ordered_digest(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return P.ordered_digest(orders, F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus"), ["o_orderkey"])


@query("""SELECT doc_id, bytes, position, running FROM (SELECT doc_id, octet_length(encode(text)) AS bytes, row_number() OVER (ORDER BY doc_id) - 1 AS position,
  CAST(sum(octet_length(encode(text))) OVER (ORDER BY doc_id) AS BIGINT) AS running FROM documents) WHERE running <= 65536""")
def byte_budget_page(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return P.page_by_bytes(docs.select("doc_id", "text"), ["doc_id"], F.octet_length("text")).select("doc_id", F.col("bytes"), "position", "running")


@query("""SELECT conv_id, turn, substr(text, 11, 40) AS page, CAST(length(text) AS BIGINT) AS total_chars, CASE WHEN length(text) > 50 THEN CAST(50 AS BIGINT) END AS next_offset FROM conversations""")
def text_page(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.text_page(F.col("text"), 10, 40).alias("p")).select("conv_id", "turn", "p.*")


@query("""SELECT doc_id, substr(text, 1, 4096) AS preview, CAST(length(text) AS BIGINT) AS value_chars, length(text) > 4096 AS value_truncated FROM documents""")
def literal_preview(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.literal_preview(F.col("text")).alias("p")).select("doc_id", "p.*")


@query("""SELECT doc_id, CAST(length(text) AS BIGINT) AS characters, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS BIGINT) AS lines FROM documents WHERE length(text) > 0""")
def source_statistics(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where(F.length("text") > 0)
    return docs.select("doc_id", F.length("text").cast("long").alias("characters"), T.line_count(F.col("text")).alias("lines"))


@query("""SELECT doc_id, CAST((length(text) - length(replace(text, 'shere', ''))) / 5 AS BIGINT) AS n_matches FROM documents WHERE contains(text, 'shere')""")
def trigram_search(spark, sf_dir):
    """Candidates by written postings of three code points, verified on the texts: the same result as the scan."""
    index = Q.kept_index(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    return Q.search_indexed(read(spark, sf_dir, "documents"), index, "doc_id", "text", "shere")


@query("""SELECT p_partkey, 'contains' AS relaxation FROM (SELECT p_partkey FROM part WHERE contains(p_name, 'ar') ORDER BY p_partkey LIMIT 20)""")
def near_match_relaxation(spark, sf_dir):
    """No part is named `ar`: those that contain it, at most 20, are suggested."""
    return Q.near_matches(read(spark, sf_dir, "part"), "p_partkey", F.col("p_name"), "ar")


@query("""SELECT page_id, count(*) AS n_links FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY page_id""")
def link_scan(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.explode(K.links(F.col("html"))).alias("link"))
    return pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))


@query("""SELECT page_id, CAST(len(string_split(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), 'ad ')) - 1 AS BIGINT) AS outside,
  CAST(len(string_split(html, 'ad ')) - len(string_split(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), 'ad ')) AS BIGINT) AS inside
FROM pages WHERE contains(html, 'ad ')""")
def comment_scoped_search(spark, sf_dir):
    """Hits inside and outside comments, by interval overlap."""
    pages = read(spark, sf_dir, "pages")
    hits = Q.matches(pages, "page_id", "html", "ad ").select("page_id", "start", "end")
    comments = Q.spans(pages, "page_id", "html", "<!--", "-->", "comment")
    marked = Q.scoped(hits, comments, "page_id", True).withColumn("i", F.lit(1)).unionByName(Q.scoped(hits, comments, "page_id", False).withColumn("i", F.lit(0)))
    return marked.groupBy("page_id").agg(F.sum((F.col("i") == 0).cast("long")).alias("outside"), F.sum("i").cast("long").alias("inside"))


@query("""SELECT e.event_id, e.user_id, (SELECT max_by(s.event_id, (s.ts, s.event_id)) FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id AND s.ts <= e.ts) AS member
FROM events e WHERE e.event_type = 'error'""")
def enclosing_member(spark, sf_dir):
    """The last signup of the same user at or before each error: an as-of join."""
    events = read(spark, sf_dir, "events")
    hits = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    marks = events.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("member"))
    return Q.enclosing(hits, marks, ["user_id"], "ts", "ts", ["member"]).select("event_id", "user_id", "member")


@query("""SELECT doc_id, ordinal, start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS k FROM ("""
       + _HITS.format(q="ti") + """SELECT doc_id, ordinal, s AS start FROM c)) WHERE k <= 3""")
def earliest_hits(spark, sf_dir):
    """The first three hits of each document."""
    return Q.matches(read(spark, sf_dir, "documents"), "doc_id", "text", "ti", per_document=3).select("doc_id", "ordinal", "start")


@query("""SELECT doc_id, CASE WHEN source = 'src3' THEN 0 WHEN NOT starts_with(source, 'src1') THEN 1 ELSE 2 END AS rank FROM documents WHERE contains(text, 'heth')""")
def search_order(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    hits = Q.counts(docs, "doc_id", "text", "heth").join(docs.select("doc_id", "source"), "doc_id")
    return Q.usages_in_order(hits, "doc_id", F.col("source"), "src3", ["src1"]).select("doc_id", "rank")


# Scopes, identifiers and references.


@query("""SELECT page_id, regexp_extract(url, '://([^/?#]+[^?#]*)', 1) AS name FROM pages
WHERE regexp_matches(regexp_extract(url, '://([^/?#]+[^?#]*)', 1), '^(www|m|blog)[.][a-z]+[.]example[.]com(/|$)') OR regexp_extract(url, '://([^/?#]+[^?#]*)', 1) LIKE 'm.ththth.example.net%'
  AND (regexp_extract(url, '://([^/?#]+[^?#]*)', 1) = 'm.ththth.example.net' OR starts_with(regexp_extract(url, '://([^/?#]+[^?#]*)', 1), 'm.ththth.example.net/'))""")
def path_scope(spark, sf_dir):
    """Hosts and paths in scope at a separator, never in the middle of a segment."""
    name = F.regexp_extract("url", r"://([^/?#]+[^?#]*)", 1)
    pages = read(spark, sf_dir, "pages").select("page_id", name.alias("name"))
    wild = F.col("name").rlike(r"^(www|m|blog)[.][a-z]+[.]example[.]com(/|$)")
    return pages.where(wild | S.in_scope(F.col("name"), ["m.ththth.example.net"], "/"))


@query("""SELECT p_partkey, p_name FROM part WHERE NOT starts_with(replace(p_name, ' ', '.'), 'blue.') AND (replace(p_name, ' ', '.') = 'red' OR starts_with(replace(p_name, ' ', '.'), 'red.') OR starts_with(replace(p_name, ' ', '.'), 'green.'))""")
def package_scope(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    name = F.replace("p_name", F.lit(" "), F.lit("."))
    return part.where(~S.excluded(name, ["blue.*"]) & S.in_scope(name, ["red", "green"]))


@query("""SELECT count(*) AS matches, count(DISTINCT event_type) AS unique_classes, count(DISTINCT user_id) AS unique_methods FROM events WHERE contains(event_type, 'c')""")
def identifier_summary(spark, sf_dir):
    hits = read(spark, sf_dir, "events").where(R.identifier_matches(F.col("event_type"), "c"))
    return R.projected(hits, "summary", owner="user_id", group="event_type")


@query("""SELECT user_id, count(*) AS matching_occurrences FROM events WHERE event_type = 'click' GROUP BY user_id""")
def identifier_callers(spark, sf_dir):
    hits = read(spark, sf_dir, "events").where(R.identifier_matches(F.col("event_type"), "CLICK", "exact", case_sensitive=False))
    return R.projected(hits, "callers", owner="user_id")


@query("""SELECT v.value, '0x' || lpad(printf('%x', v.value), 8, '0') AS hex, count(p_partkey) AS total
FROM (SELECT unnest([1, 7, 16, 50, 51, 2147483647])::BIGINT AS value) v LEFT JOIN part ON p_size = v.value GROUP BY v.value""")
def integer_totals(spark, sf_dir):
    """Totals of a batch of constants, those that never occur included."""
    return R.integer_totals(read(spark, sf_dir, "part"), ["1", "0x7", 16, 50, 51, "0x7fffffff"], 32, "p_size")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (3, 5)""")
def integer_references(spark, sf_dir):
    return R.integer_references(read(spark, sf_dir, "lineitem"), ["0x3", 5], 32, "l_linenumber").select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, reads, writes FROM (SELECT *, sum(CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END) OVER ()::BIGINT AS reads,
  sum(CASE l_returnflag WHEN 'A' THEN 1 ELSE 0 END) OVER ()::BIGINT AS writes FROM lineitem WHERE l_partkey = 7) WHERE l_returnflag = 'A'""")
def field_references(spark, sf_dir):
    """Accesses of one field by kind, with reads and writes counted before the filter."""
    kind = F.when(F.col("l_returnflag") == "R", "read").when(F.col("l_returnflag") == "A", "write")
    accesses = read(spark, sf_dir, "lineitem").withColumn("access", kind)
    rows, totals = R.field_references(accesses, F.col("l_partkey") == 7, "write")
    return rows.select("l_orderkey", "l_linenumber").join(F.broadcast(totals))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 11 AND l_returnflag = 'N'""")
def instantiations(spark, sf_dir):
    rows = R.instantiations(read(spark, sf_dir, "lineitem"), 11, "N", columns=("l_partkey", "l_returnflag", "l_suppkey"))
    return rows.select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE contains(p_name, 'red') AND p_size > 40)""")
def string_references(spark, sf_dir):
    """Operands whose pool entry holds a literal: the pool is filtered first, the facts are semi-joined."""
    pool = read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return R.holding(lines, pool, ["l_partkey"], F.col("p_name").contains("red") & (F.col("p_size") > 40))


@query("""SELECT p_partkey AS id, 0 AS source_rank FROM part WHERE p_brand = 'Brand#11' UNION ALL SELECT s_suppkey, 1 FROM supplier WHERE s_nationkey = 11""")
def type_references(spark, sf_dir):
    code = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit("[][]"))).otherwise(F.col("p_brand")).alias("type"))
    notes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")).alias("type"))
    return R.type_references(code, notes, "Brand#11").select("id", "source_rank")


@query("""SELECT mode, count(*) AS n FROM (SELECT 'exact_descriptor' AS mode FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT 'simple_name' FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT 'prefix' FROM customer WHERE starts_with(c_mktsegment, 'AUTO')) GROUP BY mode""")
def annotation_usages(spark, sf_dir):
    kinds = read(spark, sf_dir, "customer").select(F.concat(F.lit("Lnote/"), "c_mktsegment", F.lit(";")).alias("type"))
    parts = [("exact_descriptor", "Lnote/BUILDING;"), ("simple_name", "MACHINERY"), ("prefix", "Lnote/AUTO")]
    modes = [F.when(R.annotation_matches(F.col("type"), wanted, mode), F.lit(mode)) for mode, wanted in parts]
    return kinds.select(F.explode(F.filter(F.array(*modes), lambda m: m.isNotNull())).alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN quality IS NULL THEN 'unresolved' WHEN source = 'src3' THEN 'matched' ELSE 'excluded' END AS verdict, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def argument_partition(spark, sf_dir):
    sites = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return R.argument_partition(sites, F.col("source"), F.col("quality").isNotNull(), "src3").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, o_orderkey, n > 1 AS ambiguous FROM (SELECT c_custkey, o_orderkey, count(*) OVER (PARTITION BY c_custkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey)""")
def unique_call_sites(spark, sf_dir):
    """A site is ambiguous where either side has more than one candidate."""
    sites = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return R.unique_pairs(sites, read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", "o_orderkey", "ambiguous")


# Counts, coverage and three-valued facts.


@query("""SELECT lang, count(*) AS total, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS yes, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS no,
  CAST(sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unresolved FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def record_counts(spark, sf_dir):
    records = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return A.record_counts(records, "lang", F.col("quality") == 1)


@query("""SELECT source, CASE WHEN max(toxic) = 1 THEN true WHEN count(*) > count(toxic) THEN NULL ELSE false END AS exposed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def three_valued_or(spark, sf_dir):
    facts = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return facts.groupBy("source").agg(V.any_of(F.col("toxic") == 1).alias("exposed"))


@query("""SELECT reason, count(*) AS n, CAST(to_json(list(doc_id ORDER BY doc_id)[1:3]) AS VARCHAR) AS samples FROM (SELECT doc_id, coalesce('q' || quality || 't' || toxic, 'none') AS reason FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY reason""")
def coverage_histogram(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    reason = F.coalesce(F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")), F.lit("none"))
    return A.histogram(rows, reason, "doc_id").select("reason", "n", F.to_json("samples").alias("samples"))


@query("""SELECT reason, n FROM (SELECT p_name AS reason, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_name) AS k FROM part GROUP BY 1) WHERE k <= 5
UNION ALL SELECT '(other)', CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_name) AS k FROM part GROUP BY p_name) WHERE k > 5""")
def histogram_overflow(spark, sf_dir):
    return A.histogram(read(spark, sf_dir, "part"), F.col("p_name"), "p_partkey", categories=5).select("reason", "n")


@query("""SELECT CAST(to_json(list(p_type ORDER BY p_type)[1:4]) AS VARCHAR) AS "values", count(*) AS n_distinct, count(*) <= 4 AS complete FROM (SELECT DISTINCT p_type FROM part)""")
def capped_distinct(spark, sf_dir):
    return A.capped_distinct(read(spark, sf_dir, "part"), "p_type", 4).select(F.to_json("values").alias("values"), "n_distinct", "complete")


@query("""SELECT o_custkey AS source, l_suppkey AS target, CAST(sum(CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END) AS BIGINT) AS declared, CAST(sum(CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END) AS BIGINT) AS inferred
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def edge_totals(spark, sf_dir):
    sites = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return A.edge_totals(sites.select(F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target"), "l_linestatus"), "source", "target", F.col("l_linestatus") == "O")


@query("""SELECT event_type, count(*) AS units, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY event_type""")
def source_coverage(spark, sf_dir):
    return A.source_coverage(read(spark, sf_dir, "events"), "event_type")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def json_pointer(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT s_suppkey, CASE WHEN declared IS NOT NULL THEN declared = 'true' WHEN kind = 'provider' THEN sdk <= 16 WHEN has_filter AND (sdk IS NULL OR sdk >= 31) THEN NULL ELSE has_filter END AS exported
FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS declared, CASE WHEN s_suppkey % 3 = 0 THEN 'provider' ELSE 'service' END AS kind,
  s_nationkey % 2 = 0 AS has_filter, CASE WHEN s_nationkey < 20 THEN s_nationkey * 2 END AS sdk FROM supplier)""")
def exported_state(spark, sf_dir):
    """The decision table for components, with null for the unresolved."""
    s = read(spark, sf_dir, "supplier")
    declared = F.when(F.col("s_suppkey") % 5 == 0, "true").when(F.col("s_suppkey") % 5 == 1, "false")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "provider").otherwise("service")
    sdk = F.when(F.col("s_nationkey") < 20, F.col("s_nationkey") * 2)
    return s.select("s_suppkey", M.exported(declared, kind, F.col("s_nationkey") % 2 == 0, sdk).alias("exported"))


# Graphs.

_SUPPLY = """WITH RECURSIVE e AS (
  SELECT DISTINCT 'c' || o_custkey AS s, 'o' || o_orderkey AS t FROM orders
  UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem
  UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)"""


def _calls(spark, sf_dir) -> DataFrame:
    """Customers to orders to parts to suppliers."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    edges = orders.select(name("c", "o_custkey").alias("source"), name("o", "o_orderkey").alias("target"))
    edges = edges.unionByName(lines.select(name("o", "l_orderkey").alias("source"), name("p", "l_partkey").alias("target")))
    return edges.unionByName(lines.select(name("p", "l_partkey").alias("source"), name("s", "l_suppkey").alias("target")))


def _roots(spark, *names) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("root"))


@query(_SUPPLY + """, w AS (SELECT 'c5' AS root, 'c5' AS node, 0 AS depth UNION SELECT 'c77', 'c77', 0
  UNION SELECT root, t, depth + 1 FROM w JOIN e ON node = s WHERE depth < 3)
SELECT root, node, min(depth) AS depth FROM w GROUP BY root, node""")
def call_graph_callees(spark, sf_dir):
    """Breadth-first from two roots at once."""
    return G.walk(_calls(spark, sf_dir), _roots(spark, "c5", "c77"), "callees", 3)


@query(_SUPPLY + """, w AS (SELECT 's3' AS root, 's3' AS node, 0 AS depth UNION SELECT root, s, depth + 1 FROM w JOIN e ON node = t WHERE depth < 2)
SELECT root, node, min(depth) AS depth FROM w GROUP BY root, node""")
def call_graph_callers(spark, sf_dir):
    return G.walk(_calls(spark, sf_dir), _roots(spark, "s3"), "callers", 2)


@query(_SUPPLY + """, b AS (SELECT s AS f, t FROM e UNION SELECT t, s FROM e), w AS (SELECT 'o9' AS root, 'o9' AS node, 0 AS depth UNION SELECT root, t, depth + 1 FROM w JOIN b ON node = f WHERE depth < 2)
SELECT root, node, min(depth) AS depth FROM w GROUP BY root, node""")
def call_graph_both(spark, sf_dir):
    return G.walk(_calls(spark, sf_dir), _roots(spark, "o9"), "both", 2)


@query(_SUPPLY + """, w AS (SELECT 'c5' AS root, 'c5' AS node, 0 AS depth UNION SELECT root, t, depth + 1 FROM w JOIN e ON node = s WHERE depth < 2),
n AS (SELECT DISTINCT root, node FROM w WHERE NOT starts_with(node, 'p1'))
SELECT a.root, s AS source, t AS target FROM e JOIN n a ON a.node = s JOIN n b ON b.node = t""")
def call_graph_filtered(spark, sf_dir):
    """Filters drop nodes and their edges from the result and never stop the traversal."""
    edges = _calls(spark, sf_dir).distinct()
    nodes = G.walk(edges, _roots(spark, "c5"), "callees", 2)
    return G.subgraph(edges, nodes, ~F.col("node").startswith("p1")).select("root", "source", "target")


_PLACES = """WITH RECURSIVE h AS (
  SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


def _places(spark, sf_dir) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    up = read(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"))
    up = up.unionByName(read(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent")))
    return up.unionByName(read(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("child"), name("n", "s_nationkey").alias("parent")))


@query(_PLACES + """, a AS (SELECT child AS node, parent AS ancestor, 1 AS distance FROM h UNION SELECT a.node, h.parent, distance + 1 FROM a JOIN h ON h.child = a.ancestor)
SELECT node, ancestor, min(distance) AS distance FROM a GROUP BY node, ancestor""")
def hierarchy_closure(spark, sf_dir):
    return G.closure(_places(spark, sf_dir))


@query(_PLACES + """, d AS (SELECT child AS node, 1 AS distance FROM h WHERE parent = 'r2' UNION SELECT h.child, distance + 1 FROM d JOIN h ON h.parent = d.node)
SELECT 'r2' AS root, node, distance FROM d""")
def transitive_subclasses(spark, sf_dir):
    return G.descendants(_places(spark, sf_dir), _roots(spark, "r2"))


@query("""SELECT c_custkey AS class_id, n_nationkey AS via FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_acctbal >= 0""")
def implementations(spark, sf_dir):
    """Concrete descendants of a type: here customers in credit below a region."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    customers = read(spark, sf_dir, "customer")
    classes = customers.select(name("c", "c_custkey").alias("class_id"), F.col("c_custkey"), "c_nationkey", F.lit(False).alias("is_interface"), (F.col("c_acctbal") < 0).alias("is_abstract"))
    found = G.implementations(classes, G.closure(_places(spark, sf_dir)), "r1")
    return found.select(F.col("c_custkey").alias("class_id"), F.col("c_nationkey").alias("via"))


@query("""SELECT n_nationkey AS class_id FROM nation WHERE n_regionkey = 3""")
def direct_subclasses(spark, sf_dir):
    classes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_regionkey").alias("superclass"), F.lit(False).alias("is_interface"))
    return G.direct_subclasses(classes, 3).select("class_id")


@query(_PLACES + """, a AS (SELECT child AS node, parent AS up FROM h UNION SELECT a.node, h.parent FROM a JOIN h ON h.child = a.up)
SELECT node, CAST(bit_or(1 << CAST(substr(up, 2) AS INTEGER)) AS BIGINT) AS mask FROM a WHERE starts_with(up, 'r') GROUP BY node""")
def reachability_masks(spark, sf_dir):
    """Which regions reach a node, one bit each, to the fixpoint."""
    edges = _places(spark, sf_dir).select(F.col("parent").alias("source"), F.col("child").alias("target"))
    seeds = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.expr("shiftleft(1L, r_regionkey)").alias("mask"))
    return G.propagate(edges, seeds).where(~F.col("node").startswith("r"))


@query(_PLACES + """, f AS (SELECT 's' || s_suppkey AS node, CASE WHEN s_acctbal > 9000 THEN 2 WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS k FROM supplier),
a AS (SELECT child AS node, parent AS up FROM h UNION SELECT a.node, h.parent FROM a JOIN h ON h.child = a.up),
m AS (SELECT node, max(k) AS k FROM (SELECT node, k FROM f UNION ALL SELECT a.up, k FROM f JOIN a USING (node)) GROUP BY node)
SELECT node, CASE k WHEN 2 THEN true WHEN 0 THEN false END AS exposed FROM m""")
def exposure(spark, sf_dir):
    """A three-valued fact carried up a hierarchy."""
    suppliers = read(spark, sf_dir, "supplier")
    fact = F.when(F.col("s_acctbal") > 9000, True).when(F.col("s_acctbal") < 0, None).otherwise(False)
    facts = suppliers.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), fact.alias("exposed"))
    return G.exposure(_places(spark, sf_dir), facts)


@query("""SELECT c_custkey AS owner, CASE WHEN c_acctbal > 5000 THEN 'c' || c_custkey WHEN n_nationkey % 2 = 0 THEN 'n' || n_nationkey WHEN n_regionkey < 3 THEN 'r' || n_regionkey END AS declaring
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def canonical_targets(spark, sf_dir):
    """The nearest ancestor that declares a member, null where none does."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    customers, nations = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    targets = customers.select(name("c", "c_custkey").alias("owner"), F.lit("run()V").alias("member"))
    here = customers.where("c_acctbal > 5000").select(name("c", "c_custkey").alias("owner")).union(nations.where("n_nationkey % 2 = 0").select(name("n", "n_nationkey")))
    here = here.union(read(spark, sf_dir, "region").where("r_regionkey < 3").select(name("r", "r_regionkey"))).withColumn("member", F.lit("run()V"))
    found = G.canonical(targets, here, _places(spark, sf_dir))
    return found.select(F.substring("owner", 2, 20).cast("long").alias("owner"), "declaring")


@query("""WITH b AS (SELECT *, CASE WHEN p_size % 2 = 0 AND length(p_name) % 2 = 0 THEN 'k' || p_name END AS k, p_size % 3 = 0 AND length(p_type) % 3 = 0 AS gap, CASE WHEN p_size % 3 = 0 AND length(p_type) % 2 = 0 THEN 't' || p_type END AS t, substr(p_brand, 7, 1) AS m, substr(p_brand, 8, 1) AS n FROM part)
SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'p' || p_partkey WHEN gap OR (k IS NOT NULL AND t IS NOT NULL) THEN NULL WHEN k IS NOT NULL OR t IS NOT NULL THEN coalesce(k, t) WHEN n IN ('2', '4') THEN 'b' || p_brand WHEN m IN ('1', '3') THEN 'm' || m END AS declaring,
p_size <= 5 OR NOT (gap OR (k IS NOT NULL AND t IS NOT NULL)) AS complete FROM b""")
def field_declarations(spark, sf_dir):
    """Where a part's field is declared: by itself, its name or type (interfaces, some types not loaded), its brand, or the brand's maker."""
    parts = read(spark, sf_dir, "part")
    own, box, kind, brand, maker = (F.concat(F.lit(p), c) for p, c in zip("pktbm", (F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.substring("p_brand", 7, 1)), strict=True))
    named = lambda where, c: parts.where(where).select(c.alias("class_id")).distinct()
    classes = named("true", own).union(named("true", box)).union(named("length(p_type) % 3 <> 0", kind)).union(named("true", brand)).union(named("true", maker))
    fields = named("p_size <= 5", own).union(named("length(p_name) % 2 = 0", box)).union(named("length(p_type) % 2 = 0 and length(p_type) % 3 <> 0", kind)).union(named("substring(p_brand, 8, 1) in ('2', '4')", brand)).union(named("substring(p_brand, 7, 1) in ('1', '3')", maker))
    edge = lambda where, a, b, k: parts.where(where).select(a.alias("child"), b.alias("parent"), F.lit(k).alias("kind")).distinct()
    tree = edge("p_size % 2 = 0", own, box, "interface").union(edge("p_size % 3 = 0", own, kind, "interface")).union(edge("true", own, brand, "super")).union(edge("true", brand, maker, "super"))
    wanted = parts.select(own.alias("owner"), F.lit("f:I").alias("member"))
    found = G.declared_fields(wanted, fields.select(F.col("class_id").alias("owner"), F.lit("f:I").alias("member")), classes, tree)
    return found.select(F.substring("owner", 2, 20).cast("long").alias("p_partkey"), "declaring", "complete")


@query("""WITH b AS (SELECT c_custkey AS c, c_acctbal AS bal, n_nationkey AS n, n_regionkey AS r, c_custkey % 7 <> 0 AS lc, n_nationkey % 5 <> 0 AS ln FROM customer JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT *, CASE WHEN lc AND bal > 5000 THEN 'c' || c WHEN lc AND ln AND n % 2 = 0 THEN 'n' || n WHEN lc AND ln AND r = 1 THEN 'r' || r END AS declaring,
NOT ln OR r >= 3 AS outside, (NOT ln AND n % 4 = 1) OR (ln AND r = 4) AS named_outside, c % 3 = 0 OR (ln AND n % 4 = 1) OR (ln AND r = 0) AS named_inside FROM b)
SELECT c AS c_custkey, declaring, CASE WHEN declaring = 'c' || c THEN 'declared' WHEN declaring IS NOT NULL THEN 'inherited_declaration' WHEN NOT lc THEN CASE WHEN c % 3 = 0 THEN 'external_reference' ELSE 'unresolved_external' END
WHEN named_outside THEN 'inherited_external_reference' WHEN outside AND named_inside THEN 'unresolved_inherited_reference' ELSE 'missing_declaration' END AS status FROM d""")
def root_resolution(spark, sf_dir):
    """What each customer's method is, where some customers, nations and regions are not loaded and code names some of them."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    customers, nations, regions = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    c, n, r = name("c", "c_custkey"), name("n", "n_nationkey"), name("r", "r_regionkey")
    some = lambda *rows: reduce(DataFrame.union, [df.where(w).select(e.alias("owner")) for df, w, e in rows]).withColumn("member", F.lit("run()V"))
    classes = some((customers, "c_custkey % 7 <> 0", c), (nations, "n_nationkey % 5 <> 0", n), (regions, "r_regionkey < 3", r)).select(F.col("owner").alias("class_id"))
    declared = some((customers, "c_custkey % 7 <> 0 and c_acctbal > 5000", c), (nations, "n_nationkey % 5 <> 0 and n_nationkey % 2 = 0", n), (regions, "r_regionkey = 1", r))
    named = some((customers, "c_custkey % 3 = 0", c), (nations, "n_nationkey % 4 = 1", n), (regions, "r_regionkey in (0, 4)", r))
    parents = customers.where("c_custkey % 7 <> 0").select(c.alias("child"), name("n", "c_nationkey").alias("parent")).union(nations.where("n_nationkey % 5 <> 0").select(n, name("r", "n_regionkey")))
    found = G.root_resolution(some((customers, "true", c)), declared, parents, classes, named)
    return found.select(F.substring("owner", 2, 20).cast("long").alias("c_custkey"), "declaring", "status")


# Resources and markup.


@query("""WITH w AS (SELECT DISTINCT o_custkey, 'P' AS status FROM orders), v AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS v FROM orders GROUP BY 1, 2)
SELECT w.o_custkey, w.status, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NOT NULL THEN false WHEN b.v IS NOT NULL THEN true END AS inherited
FROM w LEFT JOIN v a ON a.o_custkey = w.o_custkey AND a.o_orderstatus = w.status LEFT JOIN v b ON b.o_custkey = w.o_custkey AND b.o_orderstatus = 'O'""")
def config_fallback(spark, sf_dir):
    """The value of a configuration, else of the default one, with gaps of the data: some customers have no order in P, and some of those none in O either."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), "o_orderkey")
    wanted = orders.select("o_custkey", F.lit("P").alias("status")).distinct()
    return X.with_fallback(wanted, orders.groupBy("o_custkey", "status").agg(F.min("o_orderkey").alias("v")), "o_custkey", "status", "v", "O")


@query("""WITH RECURSIVE a AS (SELECT c_custkey AS start, CASE WHEN c_custkey % 50 = 3 THEN c_custkey - 2 WHEN c_custkey % 50 = 1 THEN c_custkey + 2 ELSE c_custkey + 1 END AS nxt FROM customer WHERE c_custkey % 10 <> 0),
w AS (SELECT start, nxt AS at, 1 AS hops FROM a UNION ALL SELECT w.start, a.nxt, hops + 1 FROM w JOIN a ON a.start = w.at WHERE hops < 40)
SELECT s.start, e.at AS target, CAST(e.hops AS BIGINT) AS hops, CASE WHEN e.at IS NULL THEN 'alias_cycle' ELSE 'resolved' END AS status
FROM a s LEFT JOIN (SELECT w.* FROM w LEFT JOIN a ON a.start = w.at WHERE a.start IS NULL) e ON e.start = s.start""")
def alias_chains(spark, sf_dir):
    """Aliases followed to their ends by pointer doubling; cycles are told apart."""
    k = F.col("c_custkey")
    nxt = F.when(k % 50 == 3, k - 2).when(k % 50 == 1, k + 2).otherwise(k + 1)
    return X.follow(read(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(k.alias("start"), nxt.alias("next")))


@query("""SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '<\\1>', 'g'), '(?s)<!--.*?-->', '', 'g'), '<([a-z][a-z0-9]*)[ >/]', 1)) AS tag FROM pages) GROUP BY ALL""")
def html_nodes(spark, sf_dir):
    """Elements of pages that are no XML."""
    found = K.nodes(read(spark, sf_dir, "pages"), "page_id", "html", html=True)
    return found.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, line, content FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE contains(content, 'ationth')""")
def xml_lines(spark, sf_dir):
    return K.lines(read(spark, sf_dir, "documents"), "doc_id", "text", "ationth")


def _manifests(spark, sf_dir) -> DataFrame:
    """One manifest a supplier: an activity, an alias to it, a service and a provider, with a route."""
    suppliers = read(spark, sf_dir, "supplier")
    n = F.col("s_suppkey").cast("string")
    exported = F.when(F.col("s_suppkey") % 3 == 0, F.lit(' android:exported="true"')).when(F.col("s_suppkey") % 3 == 1, F.lit(' android:exported="false"')).otherwise(F.lit(""))
    xml = F.concat(
        F.lit('<manifest package="app.n'), n, F.lit('"><uses-sdk android:minSdkVersion="'), (F.col("s_suppkey") % 25 + 10).cast("string"),
        F.lit('"/><application android:permission="app.PERM"><activity android:name=".Main"'), exported,
        F.lit('><intent-filter><action android:name="android.intent.action.MAIN"/><category android:name="android.intent.category.LAUNCHER"/></intent-filter><intent-filter><data android:scheme="https" android:host="h'), n,
        F.lit('.example.com"/><data android:pathPrefix="/open"/></intent-filter></activity><activity-alias android:name="Door" android:targetActivity=".Main"/><service android:name="x.y.Work" android:permission="" android:enabled="'),
        (F.col("s_suppkey") % 5 > 1).cast("string"), F.lit('"/><provider android:name=".Data" android:permission="@string/p"/></application></manifest>'),
    )
    return suppliers.select(F.concat(F.lit("m"), n).alias("doc"), xml.alias("text"))


_MANIFEST_SQL = """WITH n AS (SELECT 'm' || s_suppkey AS doc, s_suppkey AS k, s_suppkey % 25 + 10 AS sdk, s_suppkey % 5 AS r, 'app.n' || s_suppkey AS p FROM supplier),
c AS (
  SELECT doc, 'activity' AS kind, p || '.Main' AS name, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE CASE WHEN sdk >= 31 THEN NULL ELSE true END END AS exported, true AS enabled, 'app.PERM' AS permission, true AS launcher FROM n
  UNION ALL SELECT doc, 'activity-alias', p || '.Door', false, true, 'app.PERM', false FROM n
  UNION ALL SELECT doc, 'service', 'x.y.Work', false, r > 1, NULL, false FROM n
  UNION ALL SELECT doc, 'provider', p || '.Data', sdk <= 16, true, NULL, false FROM n)
"""


@query(_MANIFEST_SQL + "SELECT * FROM c")
def manifest_components(spark, sf_dir):
    """Components of XML documents with effective exported, enabled and permission, and launcher activities."""
    nodes = K.nodes(_manifests(spark, sf_dir), "doc", "text")
    records = MF.resolve_aliases(MF.components(nodes))
    return records.select("doc", "kind", "name", "exported", "enabled", "permission", "launcher")


@query(_MANIFEST_SQL + """SELECT kind, count(*) AS total, CAST(sum(CASE WHEN exported THEN 1 ELSE 0 END) AS BIGINT) AS yes, CAST(sum(CASE WHEN NOT exported THEN 1 ELSE 0 END) AS BIGINT) AS no,
  CAST(sum(CASE WHEN exported IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unresolved FROM c GROUP BY ROLLUP (kind)""")
def manifest_counts(spark, sf_dir):
    records = MF.components(K.nodes(_manifests(spark, sf_dir), "doc", "text"))
    return A.record_counts(records, "kind", F.col("exported"))


@query("""SELECT 'm' || s_suppkey AS doc, 'https://h' || s_suppkey || '.example.com/open' AS uri FROM supplier WHERE s_suppkey = 7""")
def manifest_routes(spark, sf_dir):
    """Components with one filter that meets host, scheme and path together."""
    records = MF.components(K.nodes(_manifests(spark, sf_dir), "doc", "text"))
    found = MF.routes(records, host="h7.example.com", scheme="https", path="/open")
    return found.select("doc", F.explode(F.filter(F.transform("filters", lambda f: MF.literal_uri(f["data"])), lambda u: u.isNotNull())).alias("uri"))


@query(_MANIFEST_SQL + "SELECT name, kind FROM c WHERE exported IS NOT DISTINCT FROM false")
def manifest_filter(spark, sf_dir):
    records = MF.components(K.nodes(_manifests(spark, sf_dir), "doc", "text"))
    return MF.select_components(records, exported=False, fields=["name", "kind"])


@query("""SELECT p_partkey, 'red.' || replace(p_type, ' ', '') || '[]' AS type_name, 'a.P.m(ILred/X;)' || 'V' AS method FROM part""")
def identifier_functions(spark, sf_dir):
    """Descriptors to type names, and members to identifiers."""
    kind = F.replace("p_type", F.lit(" "), F.lit(""))
    part = read(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        N.type_name(F.concat(F.lit("[Lred/"), kind, F.lit(";"))).alias("type_name"),
        N.method_id(F.lit("a.P"), F.lit("m"), N.descriptors(F.lit("ILred/X;")), F.lit("V")).alias("method"),
    )


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN (l_orderkey * 40503) % 65536 >= 32768 THEN (l_orderkey * 40503) % 65536 - 65536 ELSE (l_orderkey * 40503) % 65536 END AS BIGINT) AS signed FROM lineitem""")
def bit_patterns(spark, sf_dir):
    low = (F.col("l_orderkey") * 40503) % 65536
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", B.wrap(low, 16).cast("long").alias("signed"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM documents""")
def xml_escape(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.xml_escape(F.col("text")).alias("escaped"))


@query("""SELECT s_suppkey, array_to_string(list_filter([CASE s_suppkey % 16 WHEN 0 THEN 'normal' WHEN 1 THEN 'dangerous' WHEN 2 THEN 'signature' WHEN 3 THEN 'signatureOrSystem' WHEN 4 THEN 'internal' ELSE 'unknown' END,
  CASE WHEN s_suppkey & 16 <> 0 THEN 'privileged' END, CASE WHEN s_suppkey & 32 <> 0 THEN 'development' END, CASE WHEN s_suppkey & 64 <> 0 THEN 'appop' END, CASE WHEN s_suppkey & 128 <> 0 THEN 'pre23' END,
  CASE WHEN s_suppkey & 256 <> 0 THEN 'installer' END, CASE WHEN s_suppkey & 512 <> 0 THEN 'verifier' END], lambda x: x IS NOT NULL), '|') AS protection FROM supplier WHERE s_suppkey < 1024""")
def protection_levels(spark, sf_dir):
    """Every key as flags.  The SQL names six of the twelve and ends at key 1023: on tables with larger keys (sf0.1 ends at 999) it lacks their rows."""
    return read(spark, sf_dir, "supplier").select("s_suppkey", M.protection(F.col("s_suppkey")).alias("protection"))




# Jobs, plugins and further lookups.


@query(_HITS.format(q="thwh") + "SELECT doc_id, ordinal, s AS start, line FROM c")
def resumable_search(spark, sf_dir):
    """A search job that is stopped after two of six chunks and taken up again by another: the rows of one scan."""
    import uuid

    from lodestack.sources.steps import shared_folder
    from lodestack.streaming import jobs

    path = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    make = lambda: jobs.search_job(spark, path, read(spark, sf_dir, "documents"), "doc_id", "text", "thwh", chunks=6)
    first, second = make(), make()
    first.start()
    first.run(most=2)
    second.start(resume=True)
    second.run()
    return second.results().select("doc_id", "ordinal", "start", "line")


@query("""SELECT doc_id, '{"characters": ' || length(text) || ', "lines": ' || (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END) || '}' AS result, CAST(NULL AS VARCHAR) AS error FROM documents WHERE length(text) > 0""")
def source_plugin(spark, sf_dir):
    """The sample plugin over every source; what a plugin raises would be its row's error."""
    from lodestack.functions.plugins import analyze_sources, source_statistics

    return analyze_sources(read(spark, sf_dir, "documents").where(F.length("text") > 0), "doc_id", "text", source_statistics)


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 40""")
def cursor_pages(spark, sf_dir):
    """Two pages of twenty: the second starts behind the sealed key of the first."""
    orders = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")
    order = ["o_orderdate", "o_orderkey"]
    me = P.identity(tool="orders", status="P")
    first = orders.orderBy(*order).limit(20)
    last = first.agg(F.max(F.struct(*order)).alias("k")).select(F.col("k.o_orderdate").cast("string"), "k.o_orderkey").collect()
    cursor = P.seal(me, list(last[0])) if last[0][1] is not None else None
    rest = P.after(orders, order, P.unseal(cursor, me) if cursor else None).orderBy(*order).limit(20)
    return first.unionByName(rest)


@query("""SELECT conv_id, turn, line, CAST(e - length(t) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM (
  SELECT conv_id, turn, line, t, sum(length(t) + 1) OVER (PARTITION BY conv_id, turn ORDER BY line) - 1 AS e FROM (
    SELECT conv_id, turn, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS t FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)))""")
def line_offsets(spark, sf_dir):
    """Where each line of each message starts and ends."""
    talk = read(spark, sf_dir, "conversations").withColumn("k", F.struct("conv_id", "turn"))
    return Q.line_offsets(talk, "k", "text").select("k.conv_id", "k.turn", "line", "start", "end")


@query(_PLACES + """, a AS (SELECT child AS node, parent AS up FROM h UNION SELECT a.node, h.parent FROM a JOIN h ON h.child = a.up)
SELECT p.sub, p.super, CASE WHEN p.sub = p.super OR EXISTS (SELECT 1 FROM a WHERE a.node = p.sub AND a.up = p.super) THEN true
  WHEN EXISTS (SELECT 1 FROM a WHERE a.node = p.sub AND a.up = 'r1') THEN NULL ELSE false END AS assignable
FROM (SELECT 's' || s_suppkey AS sub, 'r' || (s_suppkey % 5) AS super FROM supplier) p""")
def assignability(spark, sf_dir):
    """Proven, disproven, or unknown where an ancestor (here one region) is not loaded."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    pairs = read(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("sub"), F.concat(F.lit("r"), (F.col("s_suppkey") % 5).cast("string")).alias("super"))
    places = _places(spark, sf_dir)
    loaded = places.select("child").union(places.select("parent")).distinct().where("child <> 'r1'")
    return G.assignable(G.closure(places), pairs, loaded)


@query("""SELECT p_partkey AS id, p_brand AS configuration, 'base' AS origin FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, 'xl:' || p_brand, 'xl' FROM part WHERE p_size > 20""")
def merged_splits(spark, sf_dir):
    """A base table and a split's: configurations of the split are marked, and one id with two names would be an error."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("app").alias("package"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("configuration"), "p_size")
    return X.merge_splits(rows.where("p_size <= 25"), rows.where("p_size > 20"), "xl").select("id", "configuration", "origin")


@query("""SELECT p_partkey AS id, p_name AS name FROM part WHERE p_type = (SELECT min(p_type) FROM part) AND contains(p_name, 'e') AND p_brand = 'Brand#12'""")
def resource_lookup(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    kind = part.agg(F.min("p_type").alias("kind"))
    rows = part.select(F.col("p_partkey").alias("id"), F.lit("app").alias("package"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("configuration"), F.col("p_name").alias("value"))
    return X.select_resources(rows.join(F.broadcast(kind), "kind", "left_semi"), query="e", config="Brand#12").select("id", "name")


@query("""WITH m AS (SELECT n_nationkey AS k, n_regionkey AS r, n_name FROM nation)
SELECT 'r' || a.r || '.n' || a.k || '.run()V' AS declared, 'r' || b.r || '.c' || b.c || '.run()V' AS overriding
FROM m a JOIN (SELECT c_custkey AS c, c_nationkey AS k, n_regionkey AS r, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey) b ON a.k = b.k
WHERE a.k % 4 <> 1 AND (a.k % 4 <> 2 OR a.r = b.r) AND b.c_acctbal > 0""")
def override_edges(spark, sf_dir):
    """Which methods may run in place of an ancestor's: final ones never, package-private ones in their package."""
    nations, customers = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer").where("c_acctbal > 0")
    flags = [F.lit(False).alias("is_static"), F.lit(False).alias("is_private")]
    package = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    up = nations.select(F.concat(package, F.lit(".n"), F.col("n_nationkey").cast("string")).alias("class_id"), package.alias("package"), F.lit("run").alias("name"), F.lit("run()V").alias("signature"), *flags, (F.col("n_nationkey") % 4 == 1).alias("is_final"), (F.col("n_nationkey") % 4 == 2).alias("is_package_private"))
    both = customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.concat(package, F.lit(".c"), F.col("c_custkey").cast("string"))
    down = both.select(own.alias("class_id"), package.alias("package"), F.lit("run").alias("name"), F.lit("run()V").alias("signature"), *flags, F.lit(False).alias("is_final"), F.lit(False).alias("is_package_private"))
    tree = both.select(own.alias("node"), F.concat(package, F.lit(".n"), F.col("n_nationkey").cast("string")).alias("ancestor"))
    return G.overrides(up.unionByName(down), tree)
