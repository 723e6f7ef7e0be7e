"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

`regexp_extract_all` gives the matches of a pattern and `split` by the same pattern the text between
them, so a match starts after the lengths of all pieces and matches before it: running sums over a
document's matches give code-point spans without user code.

Every candidate value is hashed and counted over the whole corpus by distinct repositories and owners,
in two map-side combined steps (distinct value, owner and repository first, so a value that a third of
all rows hold is thinned before it is shuffled).  A value that `COPIED_OWNERS` or more owners have is a
copied example; one with fewer, that is no placeholder and has varied characters, is live-looking.

Base kinds (assign, access, hex) always give spans.  The method adds spans of further credential
shapes (jwt, key, pem) where the value is live-looking, and marks each base span.  A pem block goes from its first line to
its last one, or, where that is missing, over the coded lines that follow; a bare first line is no key.

Patterns are matched once: the matches are written with a row id, and all that follows starts from that table.  Rows
without a match take part in no shuffle.

Defined results: null and empty texts have no spans; there is no limit on length; matches of one kind
never overlap, those of different kinds may; ties are ordered by start, then kind as listed; each row of
`docs` gives one row, repeated or not; an empty table gives an empty result; only doc_id, text and the
owner and repository columns are looked at (a null owner counts as one owner).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Steps, spare

# Kinds in the order of the digest, their patterns, group of the value, least characters.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 2, 6, False),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    ("hex", r"[0-9a-f]{24,}", 0, 24, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 32, True),
    ("key", r"\b(?:ghp|gho|ghu|ghs|sk|rk|glpat|xox[abprs])[-_][A-Za-z0-9_-]{16,}", 0, 19, True),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----|\s*+(?:[A-Za-z0-9+/=]{16,}+\s*+)*+)", 0, 60, True),
)
BASE = ("assign", "access", "hex")
#: A literal that a text with a match must hold, where the pattern has one: searched first.
LITERAL = {"access": "AKIA", "jwt": "eyJ", "pem": "PRIVATE KEY-----"}
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|sample|your|xxxx|0000000|1234567|abcdef1234"
COPIED_OWNERS = 3
LEAST_DISTINCT = 6


def _matches(text: Column, at: int) -> Column:
    """Array of (kind, i, gap, size, value): the i-th match, after `gap` code points since the last one."""
    name, pattern, group, least, _ = KINDS[at]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    found = F.transform(
        hits,
        lambda hit, i: F.struct(
            F.lit(at).alias("kind"),
            i.alias("i"),
            F.char_length(F.get(gaps, i)).cast("long").alias("gap"),
            F.char_length(hit).cast("long").alias("size"),
            F.get(values, i).alias("value"),
        ),
    )
    there = text.rlike(pattern)
    if name in LITERAL:
        there = text.contains(LITERAL[name]) & there
    return F.when(there, found).otherwise(F.lit(None))


_MATCH = "struct<kind:int,i:int,gap:bigint,size:bigint,value:string>"


def matches(text: Column) -> Column:
    """Array of the matches of all kinds, each with its gap to the one before it."""
    none = F.array().cast(f"array<{_MATCH}>")
    return F.concat(*[F.coalesce(_matches(text, k), none) for k in range(len(KINDS))])


def candidates(found: DataFrame) -> DataFrame:
    """A row (row_id, owner, repository, kind, start, end, value) per match in `found` (row_id, owner, repository, found).

    A match that is too short has kind null: its row stays, so that every row_id with a match does.
    """
    rows = found.select("row_id", "owner", "repository", F.explode("found").alias("m")).select("row_id", "owner", "repository", "m.*")
    run = Window.partitionBy("row_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(run)).withColumn("start", F.col("end") - F.col("size"))
    least = F.element_at(F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (k, kind[3])]), F.col("kind"))
    long = F.char_length("value") >= least
    return rows.select("row_id", "owner", "repository", *[F.when(long, F.col(c)).alias(c) for c in ("kind", "start", "end", "value")])


def ownership(found: DataFrame) -> DataFrame:
    """Per value digest: in how many repositories and with how many owners the corpus has it."""
    each = found.where("value is not null").select(F.sha2("value", 256).alias("digest"), "owner", "repository").distinct()
    by_owner = each.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("digest").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def spans_of(found: DataFrame, steps: Steps, copied: int = COPIED_OWNERS) -> DataFrame:
    """(row_id, spans) of the rows of `found` that have a match; spans are (start, kind, end, base, live) in order."""
    rows = steps.write(candidates(found))
    counts = ownership(rows)
    hits = rows.where("value is not null").withColumn("digest", F.sha2("value", 256)).join(counts, "digest")
    body = F.regexp_replace("value", "-----[A-Z ]*-----", "")
    varied = F.size(F.array_distinct(F.split(body, ""))) >= LEAST_DISTINCT
    # Coded key bodies hold any letters, so words in them tell nothing.
    pem = F.col("kind") == [k[0] for k in KINDS].index("pem")
    live = (F.col("n_owners") < copied) & varied & (pem | ~F.col("value").rlike(PLACEHOLDER))
    base = F.col("kind") < len(BASE)
    told = hits.select("row_id", F.when(base | live, F.struct("start", "kind", "end", base.alias("base"), live.alias("live"))).alias("span"))
    short = rows.where("value is null").select("row_id", F.lit(None).cast(told.schema["span"].dataType).alias("span"))
    return told.unionByName(short).groupBy("row_id").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per row of `docs`: doc_id, and `spans`, an array of (start, kind, end, base, live) in order."""
    steps = Steps(docs.sparkSession, "secrets")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), matches(F.col("text")).alias("found"))
    rows = steps.write(rows)
    dirty = rows.where(F.size("found") > 0)
    found = spans_of(dirty, steps)
    none = F.array().cast(found.schema["spans"].dataType)
    clean = rows.where(F.size("found") == 0).select("doc_id", none.alias("spans"))
    return clean.unionByName(dirty.select("row_id", "doc_id").join(found, "row_id").select("doc_id", "spans"))


def rendered(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, owner: str = "source", mark: str = "[secret]") -> DataFrame:
    """`docs` with every live-looking span replaced, and n_chars after it; other rows as they are.

    Rows meet their spans by a row id that is written with them, whatever their doc_id is; only rows with a match
    are shuffled.
    """
    steps = Steps(docs.sparkSession, "redact")
    row, found, cuts = spare(docs, "_row"), spare(docs, "_found"), spare(docs, "_cuts")
    rows = steps.write(docs.select("*", F.monotonically_increasing_id().alias(row), matches(F.col("text")).alias(found)))
    clean, dirty = rows.where(F.size(found) == 0), rows.where(F.size(found) > 0)
    named = dirty.select(F.col(row).alias("row_id"), F.col(owner).cast("string").alias("owner"), F.col(row).cast("string").alias("repository"), F.col(found).alias("found"))
    spans = spans_of(named, steps).select(F.col("row_id").alias(row), F.filter("spans", lambda s: s["live"]).alias(cuts))
    joined = dirty.select(*docs.columns, row).join(spans, row)
    text = F.col("text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def cut(done: Column, s: Column) -> Column:
        between = F.substring(text, (done["at"] + 1).cast("int"), F.greatest(F.lit(0).cast("long"), s["start"] - done["at"]).cast("int"))
        put = F.when(s["end"] > done["at"], F.when(s["start"] >= done["at"], F.concat(between, F.lit(mark))).otherwise(F.lit(""))).otherwise(F.lit(""))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], put).alias("out"))

    done = F.aggregate(cuts, start, cut, lambda d: F.concat(d["out"], F.substring(text, (d["at"] + 1).cast("int"), F.char_length(text))))
    some = F.size(cuts) > 0
    joined = joined.withColumn("text", F.when(some, done).otherwise(text))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        joined = joined.withColumn("n_chars", F.when(some, F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))
    return clean.select(docs.columns).unionByName(joined.select(docs.columns))
