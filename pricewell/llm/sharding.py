"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks in them and shards in those. At each level a key draws one number
for every child from a hash of key and child, scales it by the child's weight and descends
into the child with the shortest waiting time ``-ln(u) / weight``. A draw does not depend on
the other children, so a changed weight moves keys only out of or into the subtree whose
weight changed, in proportion to the change, and the order of siblings has no effect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = float(1 << 53)


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def standard_tree(shards: int, base: int = 16, racks: int = 4, regions: int = 2) -> list[Leaf]:
    """A tree for the shard count alone: the first ``base`` shards spread over regions and racks.

    Each shard beyond the base comes as a region of its own. The weights of all older regions
    stay as they are, so with one more shard and the same base keys move into that shard and nowhere else.
    """
    leaves = []
    per_rack = -(-base // racks)
    racks_per_region = -(-racks // regions)
    for shard in range(shards):
        if shard < base:
            rack = shard // per_rack
            leaves.append(Leaf(f"region{rack // racks_per_region}", f"rack{rack}", shard))
        else:
            leaves.append(Leaf(f"added{shard}", "rack0", shard))
    return leaves


def _waiting(key: Column, node: str, weight: float) -> Column:
    """The key's scaled draw for a node: exponential with the node's weight as its rate."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(node), key), 11).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(UNIT)) / F.lit(weight)


def _drawn(key: Column, children: list[tuple[str, float, object]]) -> Column:
    """The label of the child with the shortest waiting time; equal times go to the lesser label."""
    if len(children) == 1:
        return F.lit(children[0][2])
    return F.least(*[F.struct(_waiting(key, n, w).alias("t"), F.lit(v).alias("v")) for n, w, v in children])["v"]


def _by(leaves: list[Leaf], field: str) -> dict[str, list[Leaf]]:
    found: dict[str, list[Leaf]] = {}
    for leaf in sorted(leaves, key=lambda x: x.shard):
        found.setdefault(getattr(leaf, field), []).append(leaf)
    return found


def _level(groups: dict[str, list[Leaf]], prefix: str) -> list[tuple[str, float, object]]:
    return [(f"{prefix}/{name}", sum(x.weight for x in of), name) for name, of in groups.items()]


def place(df: DataFrame, key_col: str, leaves: list[Leaf], prefix: str = "") -> DataFrame:
    """Adds ``region``, ``rack`` and ``shard``, each drawn below the level before.

    Leaves with a weight of zero or less get nothing. A null key is a key like any other; equal
    keys go together. Columns of the input with these names are replaced. ``prefix`` is put
    before the three names.
    """
    live = [x for x in leaves if x.weight > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    if len({x.shard for x in live}) < len(live):
        raise ValueError("a shard is named twice")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("\x00null"))
    regions = _by(live, "region")
    out = df.withColumn(f"{prefix}region", _drawn(key, _level(regions, "")))
    rack = shard = None
    for region, in_region in regions.items():
        racks = _by(in_region, "rack")
        here = F.col(f"{prefix}region") == region
        drawn = _drawn(key, _level(racks, region))
        rack = F.when(here, drawn) if rack is None else rack.when(here, drawn)
    out = out.withColumn(f"{prefix}rack", rack)
    for region, in_region in regions.items():
        for name, in_rack in _by(in_region, "rack").items():
            here = (F.col(f"{prefix}region") == region) & (F.col(f"{prefix}rack") == name)
            drawn = _drawn(key, [(f"{region}/{name}/{x.shard}", x.weight, x.shard) for x in in_rack])
            shard = F.when(here, drawn) if shard is None else shard.when(here, drawn)
    return out.withColumn(f"{prefix}shard", shard)


def numbered(df: DataFrame, group: str, order: list[str], stripes: int = 4096) -> DataFrame:
    """Adds ``slot``, the gapless number from 0 of a row in its group.

    A group is cut by a hash of its order columns into stripes. A stripe is numbered in one
    task, and starts after the sum of the stripes before it, which are at most groups times
    stripes numbers. Equal rows get different numbers. The group is never null.
    """
    striped = df.withColumn("__stripe", F.pmod(F.xxhash64(F.lit("stripe"), *order), F.lit(stripes)).cast("int"))
    sizes = striped.groupBy(group, "__stripe").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__stripe").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(group).alias("__group"),
        F.col("__stripe").alias("__in"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
    )
    inside = Window.partitionBy(group, "__stripe").orderBy(*order)
    return (
        striped.withColumn("__place", F.row_number().over(inside) - 1)
        .join(starts, (F.col(group) == F.col("__group")) & (F.col("__stripe") == F.col("__in")))
        .withColumn("slot", (F.col("__start") + F.col("__place")).cast("long"))
        .drop("__stripe", "__place", "__group", "__in", "__start")
    )


def grown(key_col: str, leaves: list[Leaf], new: Leaf, shard: str = "shard") -> Column:
    """The shard with one more region, that of the new leaf: its draw only meets the shortest one so far."""
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("\x00null"))
    now = [F.struct(_waiting(key, n, w).alias("t"), F.lit(v).alias("v")) for n, w, v in _level(_by(leaves, "region"), "")]
    least = F.least(*now) if len(now) > 1 else now[0]
    more = F.struct(_waiting(key, f"/{new.region}", new.weight).alias("t"), F.lit(new.region).alias("v"))
    return F.when(more < least, F.lit(new.shard)).otherwise(F.col(shard))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", base: int | None = None) -> DataFrame:
    """Every document with its shard, its slot there and the shard it would have with one more.

    The law is ``key``: id and shard count decide, and one more shard takes rows only into itself. ``base`` shards
    (16 or, where fewer are asked for, all) are spread over regions and racks; who grows a smaller set
    later keeps its base. Null and empty texts have size 1; a null id is placed as a key of its own; repeated rows go
    to one shard and get a slot each; further columns are ignored. No text is shuffled.
    """
    base = min(shards, 16) if base is None else base
    tree, new = standard_tree(shards, base), standard_tree(shards + 1, base)[-1]
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(narrow, "doc_id", tree)
    kept = placed.withColumn("grown_shard", grown("doc_id", tree, new)).withColumn("shard", F.col("shard").cast("int"))
    return numbered(kept, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "law",
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.col("grown_shard").cast("int").alias("grown_shard"),
        "region",
        "rack",
    )
