"""Hierarchies and call graphs by iterated joins.

The loop is in the driver, the rows never are: each level is a join of the frontier with the edges, an anti-join with what
was visited, and a written table that cuts the lineage.  Filters apply to results, never to the traversal.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.sources.steps import cut, is_written

#: Levels that a hierarchy is followed, and that a call graph may be asked for.
HIERARCHY_LEVELS, CALL_LEVELS = 256, 100
NODES_MOST, EDGES_MOST = 5_000, 20_000


class _Grown:
    """A table that grows by written parts: a part is written once, and many small ones are merged into one."""

    def __init__(self, first: DataFrame, name: str, most: int = 16):
        self.parts, self.name, self.most = [cut(first, name)], name, most

    def add(self, part: DataFrame) -> DataFrame:
        """Write a part and give it back as it was written."""
        written = cut(part, self.name)
        self.parts.append(written)
        if len(self.parts) > self.most:
            self.parts = [cut(self.df, self.name)]
        return written

    @property
    def df(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def _some(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", levels: int = HIERARCHY_LEVELS) -> DataFrame:
    """(node, ancestor, distance): every strict ancestor at its least distance; cycles end by themselves."""
    step = cut(edges.select(F.col(child).alias("_c"), F.col(parent).alias("_p")).distinct(), "edges")
    known = _Grown(step.select(F.col("_c").alias("node"), F.col("_p").alias("ancestor"), F.lit(1).alias("distance")), "closure")
    frontier = known.df
    for level in range(2, levels + 1):
        nearer = frontier.join(step, frontier["ancestor"] == step["_c"]).select("node", F.col("_p").alias("ancestor")).distinct()
        frontier = known.add(nearer.join(known.df, ["node", "ancestor"], "left_anti").withColumn("distance", F.lit(level)))
        if not _some(frontier):
            return known.df
    raise ValueError(f"the hierarchy is deeper than {levels} levels")


def descendants(edges: DataFrame, roots: DataFrame, child: str = "child", parent: str = "parent", levels: int = HIERARCHY_LEVELS) -> DataFrame:
    """(root, node, distance) below each root; only rows under the roots are expanded.  More levels are an error."""
    walked = cut(walk(edges.select(F.col(parent).alias("source"), F.col(child).alias("target")), roots, "callees", levels), "descendants")
    if _some(walked.where(F.col("depth") == levels)):
        raise ValueError(f"the hierarchy is deeper than {levels} levels")
    return walked.where("depth > 0").select("root", "node", F.col("depth").alias("distance"))


def walk(edges: DataFrame, roots: DataFrame, direction: str = "callees", depth: int = 1) -> DataFrame:
    """(root, node, depth): breadth-first from each root over edges (source, target), each node at its least depth."""
    if direction not in ("callees", "callers", "both") or not 0 <= depth <= HIERARCHY_LEVELS:
        raise ValueError("direction or depth")
    forward = edges.select(F.col("source").alias("_from"), F.col("target").alias("_to"))
    backward = edges.select(F.col("target").alias("_from"), F.col("source").alias("_to"))
    step = {"callees": forward, "callers": backward, "both": forward.unionByName(backward)}[direction]
    # Duplicate edges cost less than a shuffle of all of them: what a level reaches is made distinct anyway.
    # Edges that are a written table are read as they are.
    step = cut(step, "edges") if depth > 1 and not is_written(edges) else step
    seen = _Grown(roots.select(F.col(roots.columns[0]).alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth")), "walk")
    frontier = seen.df
    for level in range(1, depth + 1):
        reached = frontier.join(step, frontier["node"] == step["_from"]).select("root", F.col("_to").alias("node")).distinct()
        frontier = seen.add(reached.join(seen.df, ["root", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if not _some(frontier):
            break
    return seen.df


def subgraph(edges: DataFrame, nodes: DataFrame, keep: Column | None = None) -> DataFrame:
    """Edges with both ends among a walk's nodes of one root, after a filter on the nodes."""
    held = nodes if keep is None else nodes.where(keep)
    a, b = held.select("root", F.col("node").alias("source")), held.select("root", F.col("node").alias("target"))
    return edges.join(a, "source").join(b, ["root", "target"])


def capped(nodes: DataFrame, edges: DataFrame, most_nodes: int = NODES_MOST, most_edges: int = EDGES_MOST) -> tuple[DataFrame, DataFrame, bool]:
    """A report's nodes by (depth, node), its edges among them, and whether anything was left out."""
    first = cut(nodes.orderBy("depth", "node").limit(most_nodes), "report")
    among = subgraph(edges, first)
    shown = among.orderBy("source", "target").limit(most_edges)
    truncated = nodes.limit(most_nodes + 1).count() > most_nodes or among.limit(most_edges + 1).count() > most_edges
    return first, shown, truncated


def canonical(targets: DataFrame, declared: DataFrame, parents: DataFrame, levels: int = HIERARCHY_LEVELS) -> DataFrame:
    """(owner, member, declaring): the nearest class up the superclass chain that declares a member.

    targets: owner, member.  declared: owner, member.  parents: child, parent (one a child).  The walk stops at a class that
    is not loaded; what it does not find is null.  A constructor is its own class's or nobody's.
    A chain of more than `levels` classes, as a cycle makes one, is an error.
    """
    wanted = targets.select("owner", "member").distinct()
    here = cut(declared.select(F.col("owner").alias("at"), "member").distinct(), "declared")
    waiting = cut(wanted.withColumn("at", F.col("owner")), "canonical")
    found = None
    for _ in range(levels):
        hit = waiting.join(here, ["at", "member"], "left_semi").withColumnRenamed("at", "declaring")
        if found is None:
            found = _Grown(hit, "canonical")
        else:
            found.add(hit)
        up = waiting.join(here, ["at", "member"], "left_anti").where(~F.col("member").startswith("<init>"))
        waiting = cut(up.join(parents, up["at"] == parents["child"]).select("owner", "member", F.col("parent").alias("at")), "canonical")
        if not _some(waiting):
            break
    else:
        raise ValueError(f"a superclass chain is longer than {levels} classes")
    return wanted.join(found.df, ["owner", "member"], "left")


def propagate(edges: DataFrame, seeds: DataFrame, forward: bool = True, rounds: int | None = None) -> DataFrame:
    """(node, mask): the bitwise OR of the seeds (node, mask) that reach a node, to the fixpoint.

    Masks only gain bits, so it ends on any graph; a fixpoint that takes more than `rounds` is an error.
    """
    step = edges.select(F.col("source" if forward else "target").alias("_from"), F.col("target" if forward else "source").alias("_to")).distinct()
    masks = cut(seeds.groupBy("node").agg(F.bit_or("mask").alias("mask")), "propagate")
    changed = masks
    for done in count():
        if done == rounds:
            raise ValueError(f"no fixpoint in {rounds} rounds")
        sent = changed.join(step, changed["node"] == step["_from"]).groupBy(F.col("_to").alias("node")).agg(F.bit_or("mask").alias("more"))
        both = masks.join(sent, "node", "full")
        after = cut(both.select("node", F.coalesce("mask", F.lit(0)).alias("was"), F.coalesce("mask", F.lit(0)).bitwiseOR(F.coalesce("more", F.lit(0))).alias("mask")), "propagate")
        # Only nodes that gained a bit send again.
        changed = after.where("mask <> was").select("node", "mask")
        masks = after.select("node", "mask")
        if not _some(changed):
            return masks


def exposure(parents: DataFrame, facts: DataFrame, levels: int = HIERARCHY_LEVELS) -> DataFrame:
    """(node, exposed): a fact of a class holds for its loaded superclasses too; true outranks null, null false."""
    # Bits: any fact, one that is not known, one that is true.
    mask = F.when(F.col("exposed"), 5).when(F.col("exposed").isNull(), 3).otherwise(1)
    up = propagate(parents.select(F.col("child").alias("source"), F.col("parent").alias("target")), facts.select("node", mask.alias("mask")), rounds=levels)
    has = lambda bit: F.col("mask").bitwiseAND(bit) > 0
    return up.select("node", F.when(has(4), True).when(~has(2), False).alias("exposed"))


def declared_fields(wanted: DataFrame, fields: DataFrame, classes: DataFrame, hierarchy: DataFrame, levels: int = HIERARCHY_LEVELS) -> DataFrame:
    """(owner, member, declaring, complete): where the field that an operand names is declared.

    wanted, fields: owner, member.  classes: class_id, once each.  hierarchy: child, parent, kind (interface or super).  A class's own
    field comes first, then what its interfaces give, then its superclass.  `declaring` is null where no class declares
    it (then `complete`), or where an interface or class on the way is not loaded, interfaces disagree, or classes form a cycle.

    A place is a (class, member) that a lookup may pass; only places above what is wanted are made, and each is decided once,
    as soon as those above it are.
    """
    here = cut(fields.select(F.col("owner").alias("at"), "member").distinct().withColumn("own", F.lit(True)), "fields")
    known = cut(classes.select(F.col("class_id").alias("at")).distinct().withColumn("loaded", F.lit(True)), "classes")
    up = cut(hierarchy.select(F.col("child").alias("at"), F.col("parent").alias("above"), "kind").distinct(), "above")
    asked = wanted.select("owner", "member").distinct()
    told = lambda places: places.join(here, ["at", "member"], "left").join(known, "at", "left")
    places = _Grown(told(asked.withColumnRenamed("owner", "at")), "places")
    frontier = places.df
    for _ in range(levels):
        above = frontier.where("own is null and loaded").join(up, "at").select(F.col("above").alias("at"), "member").distinct()
        frontier = places.add(told(above.join(places.df.select("at", "member"), ["at", "member"], "left_anti")))
        if not _some(frontier):
            break
    else:
        raise ValueError(f"the hierarchy is deeper than {levels} levels")
    every = cut(places.df, "places")
    # `declaring` null and complete: a fully known hierarchy without the field.
    verdict = F.struct(F.when(F.col("own"), F.col("at")).alias("declaring"), F.coalesce(F.col("loaded"), F.lit(False)).alias("complete"))
    leaf = F.col("own") | F.col("loaded").isNull()
    open_places = every.where("own is null and loaded").select("at", "member")
    edges = cut(open_places.join(up, "at").select("at", "member", "above", "kind"), "place_edges")
    roots = open_places.join(edges.select("at", "member").distinct(), ["at", "member"], "left_anti")
    first = every.where(leaf).select("at", "member", verdict.alias("v")).unionByName(roots.select("at", "member", F.struct(F.lit(None).cast("string").alias("declaring"), F.lit(True).alias("complete")).alias("v")))
    done = _Grown(first, "decided")
    waiting = edges
    while _some(waiting):
        seen = done.df.select(F.col("at").alias("above"), "member", "v")
        by = waiting.join(seen, ["above", "member"], "left")
        interface, super_ = F.col("kind") == "interface", F.col("kind") == "super"
        one = by.groupBy("at", "member").agg(
            F.max((interface & F.col("v").isNull()).cast("int")).alias("open"),
            F.max((interface & ~F.col("v.complete")).cast("int")).alias("gap"),
            F.min(F.when(interface, F.col("v.declaring"))).alias("low"),
            F.max(F.when(interface, F.col("v.declaring"))).alias("high"),
            F.max(super_.cast("int")).alias("has_super"),
            F.max(F.when(super_, F.col("v"))).alias("sup"),
        )
        none = F.struct(F.lit(None).cast("string").alias("declaring"), F.lit(False).alias("complete"))
        absent = F.struct(F.lit(None).cast("string").alias("declaring"), F.lit(True).alias("complete"))
        found = F.when((F.col("gap") == 1) | (F.col("low") < F.col("high")), none).when(F.col("low").isNotNull(), F.struct(F.col("low").alias("declaring"), F.lit(True).alias("complete")))
        ready = (F.coalesce("open", F.lit(0)) == 0) & (found.isNotNull() | (F.col("has_super") == 0) | F.col("sup").isNotNull())
        decided = done.add(one.where(ready).select("at", "member", F.coalesce(found, "sup", absent).alias("v")))
        if not _some(decided):
            break
        waiting = cut(waiting.join(decided.select("at", "member"), ["at", "member"], "left_anti"), "waiting")
    out = asked.join(done.df.withColumnRenamed("at", "owner"), ["owner", "member"], "left")
    return out.select("owner", "member", "v.declaring", F.coalesce("v.complete", F.lit(False)).alias("complete"))


def root_resolution(roots: DataFrame, declared: DataFrame, parents: DataFrame, classes: DataFrame, references: DataFrame) -> DataFrame:
    """(owner, member, declaring, status) of the methods that a traversal is to start from.

    `declared` by its class, `inherited_declaration` by a loaded ancestor; else by the references (owner, member) of code:
    `external_reference` where the class is not loaded and code names the method, `inherited_external_reference` where an ancestor that
    is not loaded is named with it, `unresolved_inherited_reference` where only a loaded one is and the ancestry is not known to its end,
    `unresolved_external` where nothing names the method of a class that is not loaded, and `missing_declaration` else.  One root's
    status says nothing about the others.
    """
    found = cut(canonical(roots, declared, parents), "roots")
    owners = found.where("declaring is null").select("owner").distinct()
    chain = walk(parents.select(F.col("child").alias("source"), F.col("parent").alias("target")), owners, "callees", HIERARCHY_LEVELS)
    loaded = classes.select(F.col("class_id").alias("alias")).distinct().withColumn("loaded", F.lit(True))
    above = found.where("declaring is null").select("owner", "member").join(chain.select(F.col("root").alias("owner"), F.col("node").alias("alias"), "depth"), "owner")
    above = above.where((F.col("depth") == 0) | ~F.col("member").startswith("<")).join(loaded, "alias", "left")
    named = references.select(F.col("owner").alias("alias"), "member").distinct().withColumn("named", F.lit(True))
    yes = lambda c: F.max(F.coalesce(c, F.lit(False)))
    facts = above.join(named, ["alias", "member"], "left").groupBy("owner", "member").agg(
        yes((F.col("depth") == 0) & F.col("loaded")).alias("here"), yes(F.col("loaded").isNull()).alias("outside"), yes(F.col("named") & F.col("loaded").isNull()).alias("named_outside"), yes(F.col("named") & F.col("loaded")).alias("named_inside")
    )
    rest = (
        F.when(~F.col("here"), F.when(F.col("named_outside"), "external_reference").otherwise("unresolved_external"))
        .when(F.col("named_outside"), "inherited_external_reference")
        .when(F.col("outside") & F.col("named_inside"), "unresolved_inherited_reference")
        .otherwise("missing_declaration")
    )
    status = F.when(F.col("declaring") == F.col("owner"), "declared").when(F.col("declaring").isNotNull(), "inherited_declaration").otherwise(rest)
    return found.join(facts, ["owner", "member"], "left").select("owner", "member", "declaring", status.alias("status"))


def assignable(closure_of: DataFrame, pairs: DataFrame, loaded: DataFrame) -> DataFrame:
    """Pairs (sub, super) with `assignable`: true if proven, false if all ancestors are loaded, else null."""
    ancestors = closure_of.select(F.col("node").alias("sub"), F.col("ancestor").alias("super"), F.lit(True).alias("_yes"))
    missing = closure_of.join(loaded.select(F.col(loaded.columns[0]).alias("ancestor")), "ancestor", "left_anti").select(F.col("node").alias("sub")).distinct().withColumn("_gap", F.lit(True))
    out = pairs.join(ancestors, ["sub", "super"], "left").join(missing, "sub", "left")
    return out.select("sub", "super", F.when((F.col("sub") == F.col("super")) | F.col("_yes"), True).when(F.col("_gap"), None).otherwise(False).alias("assignable"))


def overrides(methods: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(declared, overriding): methods of descendants that override one of an ancestor.

    methods: class_id, package, name, signature, is_static, is_private, is_final.  Private and static methods override nothing and are
    not overridden, final ones are not overridden, and a package-private one only in its package.
    """
    virtual = methods.where("not is_static and not is_private and name not in ('<init>', '<clinit>')")
    up = virtual.where("not is_final").select(F.col("class_id").alias("ancestor"), F.col("package").alias("_pkg"), "signature", F.col("is_package_private").alias("_pp"))
    down = virtual.select(F.col("class_id").alias("node"), "package", "signature")
    pairs = hierarchy.join(up, "ancestor").join(down, ["node", "signature"]).where(~F.col("_pp") | (F.col("_pkg") == F.col("package")))
    return pairs.select(F.concat_ws(".", "ancestor", "signature").alias("declared"), F.concat_ws(".", "node", "signature").alias("overriding"))


def implementations(classes: DataFrame, hierarchy: DataFrame, target: str) -> DataFrame:
    """Concrete classes strictly below a class or interface."""
    below = hierarchy.where(F.col("ancestor") == target).select(F.col("node").alias("class_id"), "distance")
    return classes.where("not is_interface and not is_abstract").join(below, "class_id")


def direct_subclasses(classes: DataFrame, target: str) -> DataFrame:
    return classes.where((F.col("superclass") == target) & ~F.col("is_interface"))
