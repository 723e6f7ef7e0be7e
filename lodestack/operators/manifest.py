"""Manifest components, their filters and routes, over `xml_node` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import manifest as M
from lodestack.functions.tristate import matches as tri_matches
from lodestack.operators.markup import attribute

KINDS = ("activity", "activity-alias", "service", "receiver", "provider")
RECORD_FIELDS = ("kind", "name", "target", "exported", "exported_reason", "enabled", "permission", "permission_state", "launcher")


def components(xml_nodes: DataFrame, doc: str = "doc") -> DataFrame:
    """One row a component, with `filters`: an array of (actions, categories, data) in document order."""
    n = xml_nodes.where("error is null")
    of = lambda tag: n.where(F.col("tag") == tag)
    application = of("application").select(doc, attribute("android:enabled").alias("_app_enabled"), attribute("android:permission").alias("_app_permission"))
    root = of("manifest").select(doc, F.coalesce(attribute("package"), F.lit("")).alias("_package"))
    sdk = of("uses-sdk").groupBy(doc).agg(F.first(F.coalesce(attribute("android:targetSdkVersion"), attribute("android:minSdkVersion"))).alias("_sdk"))
    inner = n.where(F.col("tag").isin("action", "category", "data")).select(doc, F.col("parent").alias("_filter"), "idx", "tag", "attributes")
    named = lambda tag: F.sort_array(F.collect_list(F.when(F.col("tag") == tag, attribute("android:name"))))
    data = F.transform(F.sort_array(F.collect_list(F.when(F.col("tag") == "data", F.struct("idx", F.to_json("attributes").alias("a"))))), lambda d: F.from_json(d["a"], "map<string,string>"))
    inside = inner.groupBy(doc, "_filter").agg(named("action").alias("actions"), named("category").alias("categories"), data.alias("data"))
    filters = of("intent-filter").select(doc, F.col("parent").alias("idx"), F.col("idx").alias("_filter")).join(inside, [doc, "_filter"], "left")
    empty = F.array().cast("array<string>")
    entry = F.struct("_filter", F.coalesce("actions", empty).alias("actions"), F.coalesce("categories", empty).alias("categories"), F.coalesce("data", F.array().cast("array<map<string,string>>")).alias("data"))
    # Maps do not sort; the order key does, and the rest is looked up by it.
    grouped = filters.groupBy(doc, "idx").agg(F.collect_list(entry).alias("_filters"))
    listed = F.array_sort(F.col("_filters"), lambda a, b: a["_filter"].cast("int") - b["_filter"].cast("int"))
    part = n.where(F.col("tag").isin(*KINDS)).join(grouped.select(doc, "idx", listed.alias("filters")), [doc, "idx"], "left")
    part = part.join(application, doc, "left").join(root, doc, "left").join(sdk, doc, "left")
    has = F.coalesce(F.size("filters") > 0, F.lit(False))
    target_sdk = F.coalesce(F.col("_sdk"), F.lit("1")).try_cast("int") if hasattr(Column, "try_cast") else F.expr("try_cast(coalesce(_sdk, '1') as int)")
    declared, kind = attribute("android:exported"), F.col("tag")
    state = M.permission_state(attribute("android:permission"), F.col("_app_permission"))
    main = F.exists(
        "filters",
        lambda f: F.array_contains(f["actions"], "android.intent.action.MAIN") & (F.array_contains(f["categories"], "android.intent.category.LAUNCHER") | F.array_contains(f["categories"], "android.intent.category.LEANBACK_LAUNCHER")),
    )
    return part.select(
        doc,
        "idx",
        kind.alias("kind"),
        M.full_class(attribute("android:name"), F.col("_package")).alias("name"),
        M.full_class(attribute("android:targetActivity"), F.col("_package")).alias("target"),
        M.exported(declared, kind, has, target_sdk).alias("exported"),
        M.exported_reason(declared, kind, has, target_sdk).alias("exported_reason"),
        M.enabled(attribute("android:enabled"), F.col("_app_enabled")).alias("enabled"),
        state["permission"].alias("permission"),
        state["state"].alias("permission_state"),
        (kind.isin("activity", "activity-alias") & F.coalesce(main, F.lit(False))).alias("launcher"),
        F.coalesce("filters", F.array().cast(grouped.schema["_filters"].dataType)).alias("filters"),
    )


def resolve_aliases(records: DataFrame, doc: str = "doc") -> DataFrame:
    """Aliases with the permission of their target where it is unique, and activities with the aliases that name them."""
    own = records.where("kind = 'activity'").groupBy(doc, F.col("name").alias("target")).agg(F.count(F.lit(1)).alias("_n"), F.first("permission").alias("_p"))
    aliases = records.where("kind = 'activity-alias'").groupBy(doc, F.col("target").alias("name")).agg(F.sort_array(F.collect_list("name")).alias("aliases"))
    joined = records.join(own, [doc, "target"], "left").join(aliases, [doc, "name"], "left")
    declared = F.when(F.col("permission_state").isin("declared", "explicitly_none"), F.coalesce("permission", F.lit("")))
    of_alias = M.alias_permission(declared, F.col("_n"), F.col("_p"))
    return joined.withColumn("permission", F.when(F.col("kind") == "activity-alias", of_alias).otherwise(F.col("permission"))).drop("_n", "_p")


def select_components(records: DataFrame, kind: str | None = None, name: str | None = None, permission: str | None = None, query: str | None = None, exported: object = "any", fields: list[str] | None = None) -> DataFrame:
    """Records that meet every filter; `exported` is true, false, or None for the unresolved; `fields` must be known."""
    out = records if kind is None else records.where(F.col("kind") == kind)
    out = out if name is None else out.where(F.col("name").contains(name))
    out = out if permission is None else out.where(F.col("permission").contains(permission))
    out = out if exported == "any" else out.where(tri_matches(F.col("exported"), exported))
    if query is not None:
        out = out.where(F.lower(F.to_json(F.struct(*[c for c in records.columns if c != "filters"]))).contains(query.lower()))
    if fields is not None:
        if unknown := set(fields) - set(RECORD_FIELDS):
            raise ValueError(f"unknown fields {sorted(unknown)}")
        out = out.select(*fields)
    return out


def _meets(data: Column, field: str, wanted: str, mode: str, fold: bool) -> Column:
    names = {"path": ("android:path", "android:pathPrefix", "android:pathPattern")}.get(field, (f"android:{field}",))

    def one(entry: Column) -> Column:
        out = F.lit(False)
        for n in names:
            value, goal = F.element_at(entry, n), wanted
            if fold:
                value, goal = F.lower(value), wanted.lower()
            out = out | F.coalesce(value == goal if mode == "exact" else value.contains(goal), F.lit(False))
        return out

    return F.exists(data, one)


def routes(records: DataFrame, relaxed: str | None = None, fold: bool = False, **wanted: str) -> DataFrame:
    """Components with one filter in which every given field (host, scheme, path) is met by some data element.

    Hosts and schemes are exact, paths contained; `relaxed` names a field that is contained instead.
    """
    mode = lambda f: "contains" if f == "path" or f == relaxed else "exact"

    def within(f: Column) -> Column:
        out = F.lit(True)
        for field, value in wanted.items():
            out = out & _meets(f["data"], field, value, mode(field), fold)
        return out

    return records.where(F.exists("filters", within))


def near_routes(records: DataFrame, **wanted: str) -> DataFrame:
    """Where no route matches: those that match with one field relaxed, then with ASCII case folded; `relaxation` says how."""
    exact = routes(records, **wanted)
    if exact.limit(1).count():
        return exact.withColumn("relaxation", F.lit("none"))
    for field in wanted:
        found = routes(records, relaxed=field, **wanted)
        if found.limit(1).count():
            return found.withColumn("relaxation", F.lit(f"{field}: contains"))
    return routes(records, fold=True, **wanted).withColumn("relaxation", F.lit("folded"))


def literal_uri(data: Column) -> Column:
    """A URI that a filter's literal parts allow, or null where a scheme is missing."""
    first = lambda name: F.get(F.filter(F.transform(data, lambda d: F.element_at(d, name)), lambda v: v.isNotNull()), F.lit(0))
    host = F.when(first("android:host").isNotNull(), F.concat(F.regexp_replace(first("android:host"), r"^\*", "www"), F.coalesce(F.concat(F.lit(":"), first("android:port")), F.lit(""))))
    path = F.coalesce(first("android:path"), first("android:pathPrefix"), F.lit(""))
    return F.when(first("android:scheme").isNotNull(), F.concat(first("android:scheme"), F.lit("://"), F.coalesce(F.concat(host, path), F.lit(""))))


def markdown(records: DataFrame) -> DataFrame:
    """One row a component, as a line of a Markdown table."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("unresolved")), F.lit("|"), F.lit("\\|"))
    return records.select("kind", "name", F.concat(F.lit("| "), F.concat_ws(" | ", cell("kind"), cell("name"), cell("exported"), cell("enabled"), F.coalesce("permission", F.lit(""))), F.lit(" |")).alias("line"))
