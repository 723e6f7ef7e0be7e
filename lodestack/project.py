"""A loaded package as queries: one method a tool, each a DataFrame over the fact tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import names as N
from lodestack.functions import scope as S
from lodestack.functions import text as T
from lodestack.functions.tristate import any_of
from lodestack.operators import dataflow as D
from lodestack.operators import graph as G
from lodestack.operators import manifest as MF
from lodestack.operators import markup as K
from lodestack.operators import network as W
from lodestack.operators import paging as P
from lodestack.operators import references as R
from lodestack.operators import render as J
from lodestack.operators import resources as X
from lodestack.operators import search as Q
from lodestack.sources.facts import Facts
from lodestack.sources.steps import cut

#: Superclasses that make a class a component.
COMPONENTS = {"activity": "android.app.Activity", "service": "android.app.Service", "receiver": "android.content.BroadcastReceiver", "provider": "android.content.ContentProvider"}


class Project:
    """The facts of one or more packages, and everything that can be asked of them.

    Results are complete and in no order unless they are pages; `page` gives any of them a total order, an exact total and
    bounds.  `failures` tells what could not be read: absence from a result means something only while it is empty.
    """

    def __init__(self, spark: SparkSession, facts: Facts):
        self.spark, self.facts = spark, facts

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Project:
        return cls(spark, Facts(spark, path))

    def table(self, name: str) -> DataFrame:
        return self.facts.table(name)

    @property
    def failures(self) -> DataFrame:
        return self.table("failure")

    page = staticmethod(P.page)

    @cached_property
    def calls(self) -> DataFrame:
        """(class_id, method_id, pc, opcode, callee)."""
        i = self.table("dex_instruction")
        return cut(i.where("pool = 'method'").select("class_id", "method_id", "pc", "opcode", F.col("operand").alias("callee")), "calls")

    @cached_property
    def bodies(self) -> DataFrame:
        return cut(D.bodies(self.table("dex_instruction")), "bodies")

    @cached_property
    def hierarchy(self) -> DataFrame:
        return G.closure(self.table("hierarchy_edge"))

    # Lists.

    def get_all_classes(self, query: str | None = None, package_prefix: str | None = None, case_sensitive: bool = True) -> DataFrame:
        out = self.table("dex_class").select("class_id")
        out = out if query is None else out.where(T.contains(F.col("class_id"), query, case_sensitive=case_sensitive))
        return out.where(S.in_scope(F.col("class_id"), [package_prefix] if package_prefix else []))

    search_classes_by_keyword = get_all_classes

    def suggest_classes(self, query: str) -> DataFrame:
        return Q.near_matches(self.table("dex_class"), "class_id", F.col("class_id"), query)

    def get_all_resource_file_names(self, query: str | None = None) -> DataFrame:
        out = self.table("archive_entry").select("path")
        return out if query is None else out.where(F.col("path").contains(query))

    def get_strings(self, query: str | None = None) -> DataFrame:
        out = self.table("resource_variant").where("kind = 'string'")
        return out if query is None else X.select_resources(out, query=query)

    def get_dex_strings(self, class_id: str, query: str | None = None) -> DataFrame:
        """The pool of the file that holds the class."""
        home = self.table("dex_class").where(F.col("class_id") == class_id).select("dex_id")
        out = self.table("dex_string").join(home, "dex_id", "left_semi")
        return out if query is None else out.where(F.col("value").contains(query))

    def get_methods_of_class(self, class_id: str) -> DataFrame:
        return self.table("dex_method").where(F.col("class_id") == class_id)

    def get_fields_of_class(self, class_id: str) -> DataFrame:
        return self.table("dex_field").where(F.col("class_id") == class_id)

    # Hierarchy.

    def find_direct_subclasses(self, class_id: str) -> DataFrame:
        return G.direct_subclasses(self.table("dex_class"), class_id)

    def find_implementations(self, class_id: str) -> DataFrame:
        return G.implementations(self.table("dex_class"), self.hierarchy, class_id)

    def get_class_hierarchy(self, class_id: str) -> DataFrame:
        """The parents of a class, and whether each is loaded."""
        loaded = self.table("dex_class").select(F.col("class_id").alias("parent"), F.lit(True).alias("_loaded"))
        return self.table("hierarchy_edge").where(F.col("child") == class_id).join(loaded, "parent", "left").select("parent", "kind", F.coalesce("_loaded", F.lit(False)).alias("loaded"))

    def exposure(self) -> DataFrame:
        """Whether a class, or one below it, is an exported component."""
        records = self.get_manifest_components()
        facts = records.groupBy(F.col("name").alias("node")).agg(any_of(F.col("exported")).alias("exposed"))
        return G.exposure(self.table("hierarchy_edge").where("kind = 'super'"), facts)

    def components(self) -> DataFrame:
        """(class_id, component) of classes below one of the component roots."""
        roots = self.spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for k, v in COMPONENTS.items() for x in (v, k)])).alias("ancestor", "component"))
        return self.hierarchy.join(F.broadcast(roots), "ancestor").select(F.col("node").alias("class_id"), "component").distinct()

    # Search.

    def search_code(self, query: str, regex: bool = False, case_sensitive: bool = True, scope: str = "code", package_prefix: str | None = None, limit: int | None = None) -> DataFrame:
        """Matches in listings (`code`), in text members (`resources`), or in both (`all`)."""
        parts = []
        if scope in ("code", "all"):
            docs = self.table("listing").where(S.in_scope(F.col("class_id"), [package_prefix] if package_prefix else []))
            parts.append(Q.matches(docs, "method_id", "text", query, regex, case_sensitive).withColumn("source_rank", F.lit(0)))
        if scope in ("resources", "all"):
            found = Q.matches(self.table("document"), "path", "text", query, regex, case_sensitive)
            parts.append(found.withColumnRenamed("path", "method_id").withColumn("source_rank", F.lit(1)))
        if not parts:
            raise P.ContractError("INVALID_SCOPE", scope)
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return out if limit is None else out.orderBy("source_rank", "method_id", "ordinal").limit(limit)

    def search_identifiers(self, query: str, match_mode: str = "contains", case_sensitive: bool = True, symbol_kind: str = "any", occurrence: str = "any", projection: str = "full") -> DataFrame:
        """Declarations and references of classes, methods and fields by identifier."""
        own = lambda t, c, kind: self.table(t).select(F.col(c).alias("symbol"), F.lit(kind).alias("kind"), F.lit("declaration").alias("occurrence"), "class_id", F.lit(None).cast("string").alias("owner"), F.lit(None).cast("long").alias("pc"))
        declared = own("dex_class", "class_id", "class").unionByName(own("dex_method", "method_id", "method")).unionByName(own("dex_field", "field_id", "field"))
        kind = F.when(F.col("pool") == "type", "class").otherwise(F.col("pool"))
        symbol = F.when(F.col("pool") == "type", N.type_name(F.col("operand"))).otherwise(F.col("operand"))
        used = self.table("dex_instruction").where("pool in ('type', 'method', 'field')").select(symbol.alias("symbol"), kind.alias("kind"), F.lit("reference").alias("occurrence"), "class_id", F.col("method_id").alias("owner"), "pc")
        query = N.normal_selector(query) if "->" in query or "#" in query else query
        hits = declared.unionByName(used).where(R.identifier_matches(F.col("symbol"), query, match_mode, case_sensitive))
        hits = hits if symbol_kind == "any" else hits.where(F.col("kind") == symbol_kind)
        hits = hits if occurrence == "any" else hits.where(F.col("occurrence") == occurrence)
        return R.projected(hits, projection)

    def find_string_references(self, query: str, match_mode: str = "contains", package_prefix: str | None = None) -> DataFrame:
        """Loads of a literal in code, static values and annotation values, in that order."""
        wanted = lambda c: F.col(c) == query if match_mode == "exact" else F.col(c).contains(query)
        code = self.table("dex_instruction").where("pool = 'string'").where(wanted("operand")).select("class_id", F.col("method_id").alias("owner"), "pc", F.col("operand").alias("value"), F.lit("code").alias("context"))
        none = F.lit(None).cast("long").alias("pc")
        fixed = self.table("static_value").where("kind = 'string'").where(wanted("value")).select("class_id", F.col("field_id").alias("owner"), none, "value", F.lit("static_value").alias("context"))
        notes = self.table("annotation_value").where("kind = 'string'").where(wanted("value")).select("class_id", "owner", none, "value", F.lit("annotation").alias("context"))
        out = code.unionByName(fixed).unionByName(notes).where(S.in_scope(F.col("class_id"), [package_prefix] if package_prefix else []))
        return out.withColumn("preview", T.literal_preview(F.col("value")))

    def find_integer_references(self, values: list, bit_width: int = 32) -> DataFrame:
        wide = F.col("opcode").between(0x16, 0x19) if bit_width == 64 else F.col("opcode").between(0x12, 0x15)
        loads = self.table("dex_instruction").where(wide).select("class_id", "method_id", "pc", F.col("literal").alias("value"))
        return R.integer_references(loads, values, bit_width)

    def find_field_references(self, field_id: str, access: str = "all") -> tuple[DataFrame, DataFrame]:
        uses = self.table("dex_instruction").where("pool = 'field'").select("class_id", "method_id", "pc", F.col("operand").alias("field_id"), R.access_kind(F.col("opcode")).alias("access"))
        # Operands are compared by the declaration that they mean; only those of the same member can mean the same.
        parts = lambda c: (F.regexp_extract(c, r"^(.*)\.[^.:]*:", 1), F.regexp_extract(c, r"([^.:]*:.*)$", 1))
        split = lambda rows: rows.withColumns(dict(zip(("owner", "member"), parts(F.col("field_id")), strict=True)))
        asked = split(self.spark.range(1).select(F.lit(N.normal_selector(field_id)).alias("field_id")))
        near = split(uses).join(F.broadcast(asked.select("member")), "member", "left_semi")
        fields = split(self.table("dex_field").select("field_id"))
        found = G.declared_fields(near.select("owner", "member").union(asked.select("owner", "member")), fields, self.table("dex_class"), self.table("hierarchy_edge"))
        found = cut(found.select("owner", "member", F.coalesce("declaring", "owner").alias("means")), "fields")
        goal = found.join(F.broadcast(asked), ["owner", "member"]).select(F.col("means").alias("goal"))
        rows = near.join(found, ["owner", "member"]).join(F.broadcast(goal), F.col("means") == F.col("goal"))
        return R.field_references(rows.select("class_id", "method_id", "pc", "field_id", "access"), F.lit(True), access)

    def find_instantiations(self, class_id: str | None = None, allocating_class: str | None = None, allocating_method_id: str | None = None) -> DataFrame:
        made = self.table("dex_instruction").where("opcode in (34, 35, 36, 37)").select("class_id", "method_id", "pc", N.type_name(F.col("operand")).alias("type"))
        return R.instantiations(made, class_id, allocating_class, allocating_method_id)

    def find_type_references(self, class_name: str, package_prefix: str | None = None) -> DataFrame:
        code = self.table("dex_instruction").where("pool = 'type'").select("class_id", F.col("method_id").alias("owner"), "pc", N.type_name(F.col("operand")).alias("type"))
        notes = self.table("dex_annotation").select("class_id", "owner", N.type_name(F.col("type")).alias("type"))
        return R.type_references(code, notes, class_name).where(S.in_scope(F.col("class_id"), [package_prefix] if package_prefix else []))

    def find_annotation_usages(self, annotation_type: str, element: str | None = None, match_mode: str = "exact_descriptor", package_prefix: str | None = None) -> DataFrame:
        notes = self.table("dex_annotation").where(R.annotation_matches(F.col("type"), annotation_type, match_mode))
        notes = notes.where(S.in_scope(F.col("class_id"), [package_prefix] if package_prefix else []))
        if element is None:
            return notes
        values = self.table("annotation_value").where(F.col("path") == element).select("annotation_id", "path", "kind", "value")
        return notes.join(values, "annotation_id")

    def search_kotlin_metadata(self, query: str, case_sensitive: bool = True, package_prefix: str | None = None) -> DataFrame:
        names = self.table("annotation_value").where("type = 'Lkotlin/Metadata;' and path like 'd2[%' and kind = 'string'")
        names = names.where(S.in_scope(F.col("class_id"), [package_prefix] if package_prefix else []))
        return names.where(T.contains(F.col("value"), query, case_sensitive=case_sensitive)).select("class_id", "path", "value")

    # Resources and manifests.

    @cached_property
    def xml_nodes(self) -> DataFrame:
        return cut(K.nodes(self.table("document").where("path like '%.xml'"), "path", "text").withColumnRenamed("path", "doc"), "xml")

    def get_android_manifest(self, offset: int = 0, limit: int = T.PAGE_DEFAULT) -> DataFrame:
        return self.get_resource_file("AndroidManifest.xml", offset, limit)

    def get_resource_file(self, path: str, offset: int = 0, limit: int = T.PAGE_DEFAULT) -> DataFrame:
        found = self.table("document").where(F.col("path") == path)
        return found.select("path", F.sha2("text", 256).alias("sha256"), T.text_page(F.col("text"), offset, limit).alias("page")).select("path", "sha256", "page.*")

    def get_manifest_components(self, **filters) -> DataFrame:
        records = MF.resolve_aliases(MF.components(self.xml_nodes.where("doc like '%AndroidManifest.xml'")))
        return MF.select_components(records, **filters)

    def get_manifest_summary(self, style: str = "records") -> DataFrame:
        from lodestack.operators.aggregates import record_counts

        records = self.get_manifest_components()
        if style == "records":
            return records
        if style == "markdown":
            return MF.markdown(records)
        if style == "counts":
            return record_counts(records, "kind", F.col("exported"))
        if style == "exposure":
            return records.where("exported is null or exported").select("kind", "name", "exported", "exported_reason", "permission", "permission_state")
        raise P.ContractError("INVALID_FORMAT", style)

    def find_routes(self, **wanted: str) -> DataFrame:
        return MF.near_routes(self.get_manifest_components(), **wanted)

    def search_resources(self, query: str) -> DataFrame:
        return X.select_resources(self.table("resource_variant"), query=query)

    def search_assets(self, query: str, asset_prefix: str = "assets/", case_sensitive: bool = True) -> DataFrame:
        """One row a file that holds the query, with the number of occurrences."""
        docs = self.table("document").where(F.col("path").startswith(asset_prefix))
        return Q.counts(docs, "path", "text", query, case_sensitive=case_sensitive)

    def get_resource_value(self, resource_id: int | None = None, resource_name: str | None = None, config: str | None = None) -> DataFrame:
        """Variants with what their references lead to."""
        own = X.select_resources(self.table("resource_variant"), resource_id, resource_name, None, config)
        chains = X.follow(self.table("resource_variant").where("reference is not null").select(F.col("id").alias("start"), F.col("reference").alias("next")))
        return own.join(chains.select(F.col("start").alias("id"), F.col("target").alias("resolved_id"), "status"), "id", "left")

    def search_resource_xml(self, query: str) -> DataFrame:
        return K.lines(self.table("document").where("path like 'res/%.xml'"), "path", "text", query)

    def list_nav_deeplinks(self) -> DataFrame:
        return K.deep_links(self.xml_nodes, "doc")

    def find_layout_references(self, class_id: str | None = None) -> DataFrame:
        found = K.layout_references(self.xml_nodes.where("doc like '%res/layout%'"), "doc")
        return found if class_id is None else found.where((F.col("reference") == class_id) | F.lit(class_id).endswith(F.col("reference")) & F.col("reference").startswith("."))

    # Graphs.

    @cached_property
    def call_edges(self) -> DataFrame:
        """(source, target) with targets at the class that declares them, where that is loaded."""
        member = F.regexp_extract("callee", r"([^.]*\(.*)$", 1)
        owner = F.expr("substring(callee, 1, length(callee) - length(regexp_extract(callee, '([^.]*[(].*)$', 1)) - 1)")
        sites = self.calls.select(F.col("method_id").alias("source"), owner.alias("owner"), member.alias("member"))
        declared = self.table("dex_method").select(F.col("class_id").alias("owner"), F.col("signature").alias("member"))
        supers = self.table("hierarchy_edge").where("kind = 'super'").select("child", "parent")
        found = G.canonical(sites, declared, supers)
        target = F.concat(F.coalesce("declaring", "owner"), F.lit("."), "member")
        return cut(sites.join(found, ["owner", "member"], "left").select("source", target.alias("target")).distinct(), "edges")

    def dispatch_edges(self) -> DataFrame:
        """(source, target): a declared virtual method to those that may run in its place."""
        pairs = G.overrides(self.table("dex_method"), self.hierarchy)
        return pairs.select(F.col("declared").alias("source"), F.col("overriding").alias("target"))

    def get_call_graph(self, method_id: str | list[str], direction: str = "callees", depth: int = 20, dispatch: bool = False) -> DataFrame:
        """(root, node, depth) from one or several roots."""
        if not 1 <= depth <= G.CALL_LEVELS:
            raise P.ContractError("INVALID_DEPTH", str(depth))
        roots = [N.normal_selector(m) for m in ([method_id] if isinstance(method_id, str) else method_id)]
        if not 1 <= len(roots) <= 16:
            raise P.ContractError("TOO_MANY_ROOTS", str(len(roots)))
        edges = self.call_edges.unionByName(self.dispatch_edges()) if dispatch else self.call_edges
        start = cut(self.resolve_roots(roots).select(F.col("method_id").alias("root"), F.col("resolved_method_id").alias("_start")), "roots")
        walked = G.walk(edges, start.select("_start"), direction, depth).withColumnRenamed("root", "_start")
        return walked.join(F.broadcast(start), "_start").select("root", "node", "depth")

    get_call_graph_batch = get_call_graph

    def resolve_roots(self, method_ids: list[str]) -> DataFrame:
        """(method_id, resolved_method_id, status) of each root: traversal starts from the declaration that it means.

        A root that nothing declares keeps its own name, and its status tells why; the others are not touched by it.
        """
        asked = self.spark.range(1).select(F.explode(F.array(*[F.lit(N.normal_selector(m)) for m in method_ids])).alias("method_id")).distinct()
        owner = F.expr("regexp_extract(method_id, '^(.*)[.][^.(]*[(]', 1)")
        roots = asked.select(owner.alias("owner"), F.regexp_extract("method_id", r"([^.(]*\(.*)$", 1).alias("member"))
        declared = self.table("dex_method").select(F.col("class_id").alias("owner"), F.col("signature").alias("member"))
        supers = self.table("hierarchy_edge").where("kind = 'super'").select("child", "parent")
        named = self.calls.select(F.expr("regexp_extract(callee, '^(.*)[.][^.(]*[(]', 1)").alias("owner"), F.regexp_extract("callee", r"([^.(]*\(.*)$", 1).alias("member"))
        found = G.root_resolution(roots, declared, supers, self.table("dex_class"), named)
        name = lambda c: F.concat(F.col(c), F.lit("."), "member")
        return found.select(name("owner").alias("method_id"), F.coalesce(name("declaring"), name("owner")).alias("resolved_method_id"), "status")

    def semantic_edges(self) -> DataFrame:
        """(source, target, kind): what a call site may mean beyond the method it names.

        `lambda_creation`: a method makes an object of a generated class, whose overriding methods may run later;
        `possible_interface_dispatch` and `possible_virtual_dispatch`: an override may run in place of what is named.
        """
        kinds = self.table("dex_class").select(F.col("class_id").alias("_owner"), "is_interface")
        dispatch = self.dispatch_edges().withColumn("_owner", F.expr("regexp_extract(source, '^(.*)[.][^.(]*[(]', 1)")).join(kinds, "_owner", "left")
        kind = F.when(F.coalesce("is_interface", F.lit(False)), "possible_interface_dispatch").otherwise("possible_virtual_dispatch")
        made = self.table("dex_instruction").where("opcode = 34").select(F.col("method_id").alias("source"), N.type_name(F.col("operand")).alias("class_id"))
        made = made.where(F.col("class_id").rlike(r"\$\$Lambda|ExternalSyntheticLambda|\$[0-9]+$")).distinct()
        bodies = self.table("dex_method").where("has_code and not is_static and name <> '<init>'").select("class_id", F.col("method_id").alias("target"))
        lambdas = made.join(bodies, "class_id").select("source", "target", F.lit("lambda_creation").alias("kind"))
        return dispatch.select("source", "target", kind.alias("kind")).unionByName(lambdas)

    def filter_nodes(self, nodes: DataFrame, package_prefix: str | None = None, class_name: str | None = None, annotation: str | None = None, component_type: str | None = None) -> DataFrame:
        """Nodes of a finished walk that meet every filter; the root stays."""
        owner = F.expr("regexp_extract(node, '^(.*)[.][^.(]*[(]', 1)")
        out = nodes.withColumn("class_id", owner)
        root = F.col("depth") == 0
        if package_prefix is not None:
            out = out.where(root | S.in_scope(F.col("class_id"), [package_prefix]))
        if class_name is not None:
            out = out.where(root | (F.col("class_id") == class_name))
        for test, table in (
            (annotation, lambda: self.find_annotation_usages(annotation, match_mode="simple_name")),
            (component_type, lambda: self.components().where(F.col("component") == component_type)),
        ):
            if test is not None:
                held = table().select("class_id").distinct().withColumn("_held", F.lit(True))
                out = out.join(held, "class_id", "left").where(root | F.col("_held")).drop("_held")
        return out.drop("class_id")

    def enrich_sites(self, sites: DataFrame) -> DataFrame:
        """Call sites with the line of the caller's listing that makes the call."""
        lines = self.table("listing").join(sites.select("method_id").distinct(), "method_id", "left_semi")
        lines = lines.select("method_id", F.posexplode(F.split("text", "\n")).alias("_line", "text"))
        lines = lines.select("method_id", (F.col("_line") + 1).cast("long").alias("line"), "text", F.regexp_extract("text", r"^([0-9a-f]{4,}): ", 1).alias("_at")).where("_at <> ''")
        return sites.join(lines.withColumn("pc", F.conv("_at", 16, 10).cast("long")).drop("_at"), ["method_id", "pc"], "left")

    def get_call_sites(self, method_id: str, direction: str = "callers", argument: int | None = None, literal: str | None = None) -> DataFrame:
        """The sites that call a method (or that it calls); with a literal, each is matched, excluded or unresolved."""
        goal = N.normal_selector(method_id)
        sites = self.calls.where(F.col("callee" if direction == "callers" else "method_id") == goal)
        if literal is None:
            return sites
        known = D.constant_arguments(self.bodies, goal).where(F.col("argument") == (argument or 0)).select("method_id", "pc", "kind", "value")
        return R.argument_partition(sites.join(known, ["method_id", "pc"], "left"), F.col("value"), F.col("kind") != "unknown", literal)

    def resolve_method(self, selector: str) -> DataFrame:
        """Declarations that a selector may mean: a complete one names itself, another is looked up in its class and above."""
        full = N.normal_selector(selector)
        methods = self.table("dex_method")
        if N.is_complete(full):
            return methods.where(F.col("method_id") == full)
        owner, name = N.owner_of(full), full.partition("(")[0].rpartition(".")[2]
        near = methods.where((F.col("class_id") == owner) & (F.col("name") == name))
        if name == "<init>" or near.limit(1).count():
            return near
        up = self.hierarchy.where(F.col("node") == owner).select(F.col("ancestor").alias("class_id"), "distance")
        above = methods.where(F.col("name") == name).join(up, "class_id")
        nearest = above.agg(F.min("distance").alias("_d"))
        return above.join(F.broadcast(nearest), F.col("distance") == F.col("_d")).drop("_d", "distance")

    # Sources.

    def get_method_source(self, method_id: str, offset: int = 0, limit: int = T.PAGE_DEFAULT) -> DataFrame:
        own = self.table("listing").where(F.col("method_id") == N.normal_selector(method_id))
        return own.select("method_id", "sha256", T.text_page(F.col("text"), offset, limit).alias("p")).select("method_id", "sha256", "p.*")

    def get_class_disassembly(self, class_id: str) -> DataFrame:
        """The listings of a class's methods in declaration order, as one text."""
        order = self.table("dex_method").select("method_id", "idx")
        own = self.table("listing").where(F.col("class_id") == class_id).join(order, "method_id")
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda r: r["text"]), "\n\n")
        return own.groupBy("class_id").agg(text.alias("text")).withColumn("sha256", F.sha2("text", 256))

    def get_class_source(self, class_id: str, offset: int = 0, limit: int = T.PAGE_DEFAULT) -> DataFrame:
        """A page of a class as Java declarations with listings as bodies, and how its methods are covered."""
        own = lambda name: self.table(name).where(F.col("class_id") == class_id)
        source = J.class_sources(own("dex_class"), own("dex_field"), own("dex_method"), own("listing"), own("static_value"))
        return source.select("class_id", "sha256", "methods", "dex_fallback", "omitted", T.text_page(F.col("text"), offset, limit).alias("p")).select("class_id", "sha256", "methods", "dex_fallback", "omitted", "p.*")

    def class_sources(self) -> DataFrame:
        """The sources of all classes."""
        return J.class_sources(*(self.table(t) for t in ("dex_class", "dex_field", "dex_method", "listing", "static_value")))

    def find_usages(self, symbol: str) -> DataFrame:
        """Where a class, method or field is referred to, with the enclosing member: uses of an identifier that is spelled out."""
        return self.search_identifiers(symbol, "exact", occurrence="reference").where((F.col("symbol") == N.normal_selector(symbol)) | (F.col("symbol") == symbol))

    def resolve_reference(self, method_id: str, source_hash: str, line: int) -> DataFrame:
        """What the instruction on a line of a listing refers to; another version of the source is an error."""
        own = self.table("listing").where(F.col("method_id") == N.normal_selector(method_id))
        checked = own.withColumn("text", F.when(F.col("sha256") == source_hash, F.col("text")).otherwise(F.raise_error(F.lit("SOURCE_CHANGED"))))
        at = F.regexp_extract(F.get(F.split("text", "\n"), F.lit(line - 1)), r"^([0-9a-f]{4,}): ", 1)
        place = checked.select("method_id", F.conv(F.when(at != "", at), 16, 10).cast("long").alias("pc")).where("pc is not null")
        return place.join(self.table("dex_instruction"), ["method_id", "pc"]).select("method_id", "pc", "name", "pool", "operand")

    def search_definitions(self, query: str, regex: bool = False) -> DataFrame:
        """Definitions of classes, methods and fields whose simple name matches."""
        own = lambda t, c, kind, name: self.table(t).select(F.col(c).alias("symbol"), F.lit(kind).alias("kind"), name.alias("name"))
        every = own("dex_class", "class_id", "class", N.simple_type(F.col("class_id"))).unionByName(own("dex_method", "method_id", "method", F.col("name"))).unionByName(own("dex_field", "field_id", "field", F.col("name")))
        return every.where(T.contains(F.col("name"), query, regex))

    def resource_aliases(self, query: str) -> DataFrame:
        """What else a query for a resource means: a number also its symbol, a symbol also its number."""
        table = self.table("resource_variant").select("id", "package", "kind", "name").distinct()
        symbol = F.concat(F.lit("R."), "kind", F.lit("."), "name")
        number = F.concat(F.lit("0x"), F.lower(F.lpad(F.hex("id"), 8, "0")))
        out = table.select("id", symbol.alias("symbol"), number.alias("hex"), F.col("id").cast("string").alias("decimal"))
        return out.where((F.col("symbol") == query) | (F.col("hex") == query.lower()) | (F.col("decimal") == query))

    # Evidence.

    def constant_arguments(self, callee: str | None = None) -> DataFrame:
        return D.constant_arguments(self.bodies, callee and N.normal_selector(callee))

    def find_config_key_consumers(self, key: str) -> DataFrame:
        """Calls that get a key as a proven constant argument."""
        return D.constant_arguments(self.bodies).where((F.col("kind") == "string") & (F.col("value") == key))

    def get_lambda_branch(self, discriminator: str) -> DataFrame:
        return D.switch_branch(self.bodies, N.normal_selector(discriminator))

    def resolve_switch_case_callers(self, class_id: str, case: int) -> DataFrame:
        """Sites that construct a class with a case as a constant argument; those with an unknown one are unresolved."""
        sites = self.calls.where(F.col("callee").startswith(f"{class_id}.<init>(")).select("method_id", "pc", "callee")
        known = D.constant_arguments(self.bodies).where(F.col("callee").startswith(f"{class_id}.<init>("))
        best = known.groupBy("method_id", "pc").agg(F.max((F.col("value") == str(case)) & (F.col("kind") == "bits")).alias("hit"), F.max(F.col("kind") == "unknown").alias("open"))
        verdict = F.when(F.coalesce("hit", F.lit(False)), "matched").when(F.coalesce("open", F.lit(True)), "unresolved").otherwise("excluded")
        return sites.join(best, ["method_id", "pc"], "left").select("method_id", "pc", "callee", verdict.alias("verdict"))

    def find_network_stacks(self, projection: str = "all") -> DataFrame:
        services = W.services(self.table("dex_class"), self.table("dex_method"), self.table("dex_annotation"), self.table("annotation_value"))
        if projection == "services":
            return services
        used = W.api_usage(self.calls).groupBy("class_id", F.col("client").alias("detail")).agg(F.count(F.lit(1)).alias("sites"))
        shapes = W.structural_stack(self.table("dex_field"), self.table("dex_method")).select("class_id", F.col("role").alias("detail"), F.lit(None).cast("long").alias("sites"))
        rows = services.select("class_id", F.concat_ws(" ", "verb", "route").alias("detail"), F.lit(None).cast("long").alias("sites"))
        return used.withColumn("evidence", F.lit("api_usage")).unionByName(shapes.withColumn("evidence", F.lit("structural_stack"))).unionByName(rows.withColumn("evidence", F.lit("service_method")))

    def service_creations(self) -> DataFrame:
        return W.creations(D.constant_arguments(self.bodies))

    def resource_arguments(self) -> DataFrame:
        """Calls whose argument is proven to be a resource of the kind that the called method takes."""
        return X.resource_arguments(D.constant_arguments(self.bodies), self.table("resource_variant"))

    def list_annotation_deeplinks(self) -> DataFrame:
        """(class_id, owner, type, uri): addresses in annotations that declare destinations, arrays included."""
        wanted = F.regexp_extract("type", r"([^/$;]+);$", 1).rlike("(?i)destination|deeplink") & F.regexp_extract("path", r"^([a-z]+)", 1).isin("uri", "uris", "value", "path", "paths")
        return self.table("annotation_value").where(wanted & (F.col("kind") == "string")).select("class_id", "owner", "type", F.col("value").alias("uri"))

    def services_outside(self, package_prefix: str) -> DataFrame:
        """One row: how many service methods a scope holds, and how many it leaves out."""
        inside = S.in_scope(F.col("class_id"), [package_prefix])
        return self.find_network_stacks("services").agg(F.count(F.when(inside, 1)).alias("inside"), F.count(F.when(~inside, 1)).alias("outside"))

    def bundle_reads(self) -> DataFrame:
        """(method_id, pc, callee, key): values that methods read from bundles and intents; key null where it is not proven."""
        read = F.col("callee").rlike(r"^android\.(os\.Bundle|content\.Intent)\.(get|has|contains)[A-Za-z]*\(Ljava/lang/String;")
        known = D.constant_arguments(self.bodies).where(read & (F.col("argument") == 0))
        return known.select("method_id", "pc", "callee", F.when(F.col("kind") == "string", F.col("value")).alias("key"))

    def find_webview_chooser_flows(self) -> DataFrame:
        """Where results of a picked file may reach a web view's callback."""
        # What yields a picked URI, what carries it, and the callback that takes it.
        sources = {"android.content.Intent.getData()Landroid/net/Uri;": 1, "android.content.Intent.getClipData()Landroid/content/ClipData;": 2, "android.webkit.WebChromeClient$FileChooserParams.parseResult(ILandroid/content/Intent;)[Landroid/net/Uri;": 4}
        carriers = {"android.content.ClipData.getItemAt(I)Landroid/content/ClipData$Item;": 0, "android.content.ClipData$Item.getUri()Landroid/net/Uri;": 0}
        return D.marked_flows(self.bodies, sources, {"android.webkit.ValueCallback.onReceiveValue(Ljava/lang/Object;)V": 0}, carriers)

    def find_forwarders(self) -> DataFrame:
        return D.forwarders(self.bodies, self.table("dex_method").where("is_static"))

    def cross_namespace_calls(self) -> DataFrame:
        return D.cross_namespace_calls(self.calls)
