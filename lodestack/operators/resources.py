"""Resource tables: lookup, configuration fallback, alias chains, split merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.sources.steps import cut

ALIAS_LEVELS = 32


def select_resources(resources: DataFrame, resource_id: int | None = None, name: str | None = None, query: str | None = None, config: str | None = None) -> DataFrame:
    """Rows of (id, package, kind, name, configuration, value) by id, by `[package:]kind/name`, by substring, by configuration."""
    out = resources
    if resource_id is not None:
        out = out.where(F.col("id") == resource_id)
    if name is not None:
        package, _, rest = name.rpartition(":")
        kind, _, own = rest.partition("/")
        out = out.where((F.col("kind") == kind) & (F.col("name") == own))
        out = out.where(F.col("package") == package) if package else out
    if query is not None:
        out = out.where(F.col("name").contains(query) | F.col("value").contains(query))
    return out if config is None else out.where(F.col("configuration") == config)


def with_fallback(wanted: DataFrame, variants: DataFrame, key: str, config: str, value: str, default: str = "") -> DataFrame:
    """Each (key, config) with the value of that configuration, else of the default one, else null; `inherited` tells which.

    One join: a key's exact and default variants are reduced to one row by a map-side combined minimum.
    """
    candidates = variants.select(F.col(key), F.col(config).alias("_config"), F.col(value).alias("_value"))
    near = wanted.join(candidates, key, "left").where(F.col("_config").isNull() | (F.col("_config") == F.col(config)) | (F.col("_config") == default))
    best = near.groupBy(key, config).agg(F.min(F.when(F.col("_config").isNotNull(), F.struct((F.col("_config") != F.col(config)).alias("inherited"), F.col("_value").alias("value")))).alias("b"))
    return wanted.join(best, [key, config], "left").withColumns({"value": F.col("b.value"), "inherited": F.col("b.inherited")}).drop("b")


def follow(aliases: DataFrame, levels: int = ALIAS_LEVELS) -> DataFrame:
    """(start, target, hops, status) of each (start, next) chain: `resolved` at its end, `alias_cycle`, or `too_deep`.

    Pointers are doubled, so a chain of n takes log n joins.  A chain of more than `levels` hops that ends is `too_deep`; a cycle is what has
    not ended after as many hops as there are aliases.
    """
    hop = cut(aliases.groupBy("start").agg(F.min("next").alias("target")).withColumn("hops", F.lit(1).cast("long")), "alias")
    done, every = 1, hop.count()
    while done <= every:
        far = hop.select(F.col("start").alias("_s"), F.col("target").alias("_t"), F.col("hops").alias("_h"))
        joined = hop.join(far, hop["target"] == far["_s"], "left")
        hop_next = cut(joined.select("start", F.coalesce("_t", "target").alias("target"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"), F.col("_t").isNotNull().alias("moved")), "alias")
        moving = hop_next.where("moved").limit(1).count()
        hop = hop_next.drop("moved")
        if not moving:
            break
        done *= 2
    starts = aliases.select(F.col("start").alias("target")).distinct().withColumn("_open", F.lit(True))
    # What still points at an alias after that many hops never ends.
    out = hop.join(starts, "target", "left")
    status = F.when(F.col("_open").isNull(), F.when(F.col("hops") > levels, "too_deep").otherwise("resolved")).otherwise("alias_cycle")
    return out.select("start", F.when(F.col("_open").isNull(), F.col("target")).alias("target"), F.when(F.col("_open").isNull(), F.col("hops")).alias("hops"), status.alias("status"))


def merge_splits(base: DataFrame, split: DataFrame, origin: str) -> DataFrame:
    """Variants of a base and one split, the split's configurations marked with it; one id under two names is an error."""
    both = base.withColumn("origin", F.lit("base")).unionByName(split.withColumns({"origin": F.lit(origin), "configuration": F.concat(F.lit(f"{origin}:"), "configuration")}), allowMissingColumns=True)
    clash = both.groupBy("id").agg(F.countDistinct("package", "kind", "name").alias("names")).where("names > 1")
    fail = F.raise_error(F.concat(F.lit("RESOURCE_CONFLICT: "), F.col("id").cast("string"))).cast("boolean")
    bad = clash.select("id", fail.alias("_bad"))
    return both.join(bad, "id", "left").where(F.coalesce("_bad", F.lit(True))).drop("_bad")


def rendered_value(kind: Column, data: Column, string: Column) -> Column:
    """A typed value as text.  Kinds: null, reference, attribute, string, float, int_dec, int_hex, boolean, color."""
    hexed = F.lower(F.lpad(F.hex(data.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return (
        F.when(kind == "null", F.lit("@null"))
        .when(kind == "reference", F.concat(F.lit("@0x"), hexed))
        .when(kind == "attribute", F.concat(F.lit("?0x"), hexed))
        .when(kind == "string", string)
        .when(kind == "int_dec", data.cast("string"))
        .when(kind == "int_hex", F.concat(F.lit("0x"), hexed))
        .when(kind == "boolean", (data != 0).cast("string"))
        .when(kind == "color", F.concat(F.lit("#"), hexed))
    )


# Framework methods by simple signature, the argument that is a resource, and its kind.
CONTRACTS = (
    ("setContentView(I)V", 0, "layout"), ("inflate(ILandroid/view/ViewGroup;)Landroid/view/View;", 0, "layout"), ("inflate(ILandroid/view/ViewGroup;Z)Landroid/view/View;", 0, "layout"),
    ("getString(I)Ljava/lang/String;", 0, "string"), ("getText(I)Ljava/lang/CharSequence;", 0, "string"), ("setText(I)V", 0, "string"), ("setTitle(I)V", 0, "string"),
    ("getColor(I)I", 0, "color"), ("getDrawable(I)Landroid/graphics/drawable/Drawable;", 0, "drawable"), ("setImageResource(I)V", 0, "drawable"), ("findViewById(I)Landroid/view/View;", 0, "id"),
)


def resource_arguments(arguments: DataFrame, resources: DataFrame) -> DataFrame:
    """(method_id, pc, callee, id, kind, name): proven arguments that are resources by the contract of what is called."""
    listed = F.array(*[F.struct(F.lit(s).alias("member"), F.lit(a).cast("long").alias("argument"), F.lit(k).alias("kind")) for s, a, k in CONTRACTS])
    contracts = arguments.sparkSession.range(1).select(F.explode(listed).alias("c")).select("c.*")
    member = F.regexp_extract("callee", r"([^.]*\(.*)$", 1)
    proven = arguments.where("kind = 'bits'").select("method_id", "pc", "callee", "argument", F.col("value").cast("long").alias("id"), member.alias("member"))
    known = resources.select("id", "kind", "name").distinct()
    return proven.join(F.broadcast(contracts), ["member", "argument"]).join(known, ["id", "kind"]).select("method_id", "pc", "callee", "id", "kind", "name")
