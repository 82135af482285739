"""Merkle manifest of a dataset.

Rows are leaves of one tree for each group; the groups' roots are the leaves of a last tree. Every level is a
table of (tree, idx, digest). A level is joined with itself on the computed index of each sibling: ``idx ^ 1``
in a binary tree, else the other slots of the same run, one offset after the other. The rows of slot zero
then hash themselves and their siblings to the next level. Proofs go the other way: a node's proof is what
its level's join has found, before its parent's proof.

A proof is a text: for each level what stands left of the node, ``|``, and what stands right of it, with a
comma between levels. So a level is folded by one hash, and the digests alone, left to right and upwards, are
what is left without the separators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.llm.ordering import positioned, runs, sorted_parts
from pricewell.operators.keys import joined_on
from pricewell.session import materialized


#: Levels whose proofs are put together in one plan.
PLAN_LEVELS = 6


def field(value: Column) -> Column:
    """A value as ``bytes:text``, null as ``-``, so that no two lists of values read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds ``left`` and ``right``: the digests beside a node in its run, in order."""
    slot = F.col("idx") % arity
    out = nodes
    for step in range(1, arity):
        index = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + step) % arity
        other = nodes.select("tree", F.col("idx").alias("sibling"), F.col("digest").alias(f"beside{step}"))
        out = out.withColumn("sibling", index).join(other, ["tree", "sibling"], "left")
    found = F.array(*[F.struct(((slot + s) % arity).alias("s"), F.col(f"beside{s}").alias("d")) for s in range(1, arity)])
    found = F.array_sort(F.filter(found, lambda b: b["d"].isNotNull()))
    put = lambda side: F.array_join(F.transform(F.filter(found, side), lambda b: b["d"]), "")
    return out.select(*nodes.columns, put(lambda b: b["s"] < slot).alias("left"), put(lambda b: b["s"] > slot).alias("right"))


def _up(count: Column, arity: int) -> Column:
    return F.floor((count + (arity - 1)) / arity)


def _height(count: Column, arity: int) -> Column:
    """Levels above the leaves of a tree of so many."""
    step = lambda s: F.when(s["n"] > 1, F.struct(_up(s["n"], arity).alias("n"), (s["h"] + 1).alias("h"))).otherwise(s)
    start = F.struct(count.cast("long").alias("n"), F.lit(0).alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, lambda s, _: step(s))["h"]


def _levels(leaves: DataFrame, heights: set[int], arity: int) -> list[DataFrame]:
    """Tables (tree, idx, nodes, digest, left, right) from the leaves up; a tree ends at its root, where ``nodes`` is 1."""
    levels = []
    now = leaves
    for height in range(max(heights, default=0) + 1):
        alone = height == max(heights, default=0)
        level = now.withColumns({"left": F.lit(""), "right": F.lit("")}) if alone else _with_siblings(now, arity)
        levels.append(materialized(level, "level"))
        slot_zero = levels[-1].where((F.col("nodes") > 1) & (F.col("idx") % arity == 0))
        now = slot_zero.select(
            "tree",
            F.floor(F.col("idx") / arity).alias("idx"),
            _up(F.col("nodes"), arity).alias("nodes"),
            F.sha2(F.concat("digest", "left", "right"), 256).alias("digest"),
        )
    return levels


def _proofs(levels: list[DataFrame], heights: set[int], above: DataFrame | None, arity: int) -> DataFrame:
    """The leaves with their proof; ``above`` holds the proof of each tree's root, none is an empty one."""
    proofs = None
    own = F.concat("left", F.lit("|"), "right")
    for height, level in reversed(list(enumerate(levels))):
        kept = [c for c in level.columns if c not in {"nodes", "digest", "left", "right"}]
        parts = []
        if height in heights:
            roots = level.where("nodes = 1")
            roots = roots.withColumn("proof", F.lit("")) if above is None else roots.join(above, "tree")
            parts.append(roots.select(*kept, "proof"))
        if proofs is not None:
            upper = proofs.select("tree", F.col("idx").alias("up"), F.col("proof").alias("rest"))
            inner = level.where("nodes > 1").withColumn("up", F.floor(F.col("idx") / arity)).join(upper, ["tree", "up"])
            parts.append(inner.select(*kept, F.concat_ws(",", own, F.when(F.col("rest") != "", F.col("rest"))).alias("proof")))
        proofs = reduce(DataFrame.union, parts)
        if height and height % PLAN_LEVELS == 0:
            proofs = materialized(proofs, "upper-proofs")
    return proofs


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    steps = F.filter(F.split(proof, ","), lambda x: x != "")

    def up(digest: Column, step: Column) -> Column:
        sides = F.split(step, r"\|", 2)
        return F.sha2(F.concat(sides[0], digest, sides[1]), 256)

    return F.aggregate(steps, start, up)


def proof_digests(proof: Column) -> Column:
    """The siblings' digests of a proof, level by level and left to right."""
    return F.translate(proof, "|,", "")


def manifest(rows: DataFrame, group: str, order: str, digest: str = "leaf", arity: int = 2) -> DataFrame:
    """The rows with ``subroot`` (of their group's tree), ``root`` and ``proof``.

    ``digest`` holds each row's leaf. In a group leaves ascend by ``order``, null first, equal ones by digest: rows
    equal in all three are leaves of their own, whose proofs differ. A null group is a group like any other and
    comes first, the others in the order of their UTF-8 bytes. A tree of one leaf has that leaf as its root. An
    empty table has no rows. Further columns stay, except those named like the three new ones.
    """
    if arity < 2:
        raise ValueError("a tree needs runs of at least two")
    rest = [c for c in rows.columns if c.lower() not in {"subroot", "root", "proof"}]
    keyed = rows.select(F.struct(*rest).alias("row"), F.col(group).alias("grp"), F.col(order).alias("ord"), F.col(digest).alias("digest"))
    placed = sorted_parts(keyed, ["grp"], ["ord", "digest"], "leaves")
    found = materialized(runs(placed, ["grp"]), "runs")
    # the groups, numbered in their order, are the leaves of the last tree
    groups = sorted_parts(found.select(F.lit(0).alias("all"), "grp", "group_rows").distinct(), ["all"], ["grp"], "groups")
    trees = positioned(groups, runs(groups.drop("group_rows"), ["all"]), ["all"])
    trees = materialized(trees.select("grp", F.col("position").alias("tree")), "trees")
    n = trees.count()
    heights = {r[0] for r in found.select(_height(F.col("group_rows"), arity)).distinct().collect()}  # at most 64 numbers
    top_height = trees.sparkSession.range(1).select(_height(F.lit(n), arity)).first()[0]

    leaves = positioned(placed, joined_on(found, trees, ["grp"]), ["grp"])
    leaves = leaves.select("row", "tree", F.col("position").alias("idx"), F.col("group_rows").alias("nodes"), "digest")
    levels = _levels(materialized(leaves, "leaves"), heights, arity)
    ends = [levels[h].where("nodes = 1").select("tree", "digest") for h in sorted(heights)] or [levels[0].select("tree", "digest")]
    roots = materialized(reduce(DataFrame.union, ends), "subroots")
    top = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n).cast("long").alias("nodes"), "digest", "tree")
    top = top.toDF("tree", "idx", "nodes", "digest", "of")
    top_levels = _levels(top, {top_height}, arity)
    root = top_levels[-1].select("digest").first()
    above = _proofs(top_levels, {top_height}, None, arity).select(F.col("of").alias("tree"), "proof")
    of_tree = roots.withColumnRenamed("digest", "subroot").join(above, "tree").withColumn("root", F.lit(root.digest if root else None).cast("string"))
    of_tree = materialized(of_tree, "proofs")

    proofs = _proofs(levels, heights or {0}, of_tree.select("tree", "proof"), arity)
    out = proofs.join(of_tree.select("tree", "subroot", "root"), "tree")
    return out.select("row.*", "subroot", "root", "proof")
