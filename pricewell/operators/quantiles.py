"""Exact values at given ranks of groups of any size, found by sketches instead of sorting.

For each rank a bracket of values is known that holds it, with the exact numbers of values below and inside. A round
sketches what is inside (KLL, merged from all tasks), takes the sketch's guess of a narrower bracket and counts: either
the rank is in there, or it is in what is left beside it, which the counts tell as well. So a wrong guess costs a
round and never a wrong value. When few values are left inside they are counted and the one at the rank is
picked. A task sends a sketch or some numbers for each group, however many values there are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricewell.operators.keys import joined_on
from pricewell.operators.sizing import broadcast_if_small
from pricewell.session import materialized

#: Size of a sketch, and how far around a rank its guess reaches, as a share of the values.
SKETCH = 400
REACH = 0.02
#: Parts between the values that are asked of a sketch.
GRID = 100
#: So many values of a group are sorted at the end.
PICKED = 100_000


def values_at(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]],
    picked: int = PICKED,
    reach: float = REACH,
) -> DataFrame:
    """One row per group with ``n`` (its values) and for each name the value at a rank, counted from zero.

    A rank is made of the number of values. The values are whole numbers; null ones do not count, and groups
    without any have no row. A null key is a key like any other. A rank outside the group gives null.
    """
    rows = materialized(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("bigint").alias("v")), "values")
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    state = groups
    for name, rank in ranks.items():
        columns = {f"rank_{name}": rank(F.col("n")).cast("bigint"), f"low_{name}": F.col("least"), f"high_{name}": F.col("most")}
        state = state.withColumns({**columns, f"below_{name}": F.lit(0).cast("bigint"), f"inside_{name}": F.col("n")})
    state = materialized(state.drop("least", "most"), "brackets")
    col = lambda part, name: F.col(f"{part}_{name}")
    wide = lambda name: (col("inside", name) > picked) & (col("low", name) < col("high", name))
    any_wide = lambda: F.greatest(*[wide(name).cast("int") for name in ranks], F.lit(0)) == 1

    while not state.where(any_wide()).isEmpty():
        open_ = state.where(any_wide())
        met = joined_on(rows, broadcast_if_small(open_), keys)
        within = {name: wide(name) & F.col("v").between(col("low", name), col("high", name)) for name in ranks}
        sketches = [F.kll_sketch_agg_bigint(F.when(inside, F.col("v")), SKETCH).alias(f"sketch_{name}") for name, inside in within.items()]
        guessed = joined_on(open_, met.groupBy(*keys).agg(*sketches), keys)
        grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
        for name in ranks:
            share = (col("rank", name) - col("below", name) + 0.5) / col("inside", name)
            known = F.kll_sketch_get_quantile_bigint(col("sketch", name), grid)
            at = lambda place, known=known: F.get(known, F.least(F.greatest(place, F.lit(0)), F.lit(GRID)).cast("int"))
            first, last = at(F.floor((share - reach) * GRID)), at(F.ceil((share + reach) * GRID))
            # a guess that is no narrower gives way to a single value
            same = (first <= col("low", name)) & (last >= col("high", name))
            point = at(F.round(share * GRID))
            guessed = guessed.withColumns(
                {f"from_{name}": F.when(wide(name), F.when(same, point).otherwise(first)), f"to_{name}": F.when(wide(name), F.when(same, point).otherwise(last))}
            )
        guessed = materialized(guessed.drop(*[f"sketch_{name}" for name in ranks]), "guesses")
        met = joined_on(rows, broadcast_if_small(guessed), keys)
        counts = []
        for name in ranks:
            counts.append(F.count_if(F.col("v") < col("from", name)).alias(f"under_{name}"))
            counts.append(F.count_if(F.col("v").between(col("from", name), col("to", name))).alias(f"among_{name}"))
        counted = joined_on(guessed, met.groupBy(*keys).agg(*counts), keys)
        narrowed = {}
        for name in ranks:
            rank, under, over = col("rank", name), col("under", name), col("under", name) + col("among", name)
            end = col("below", name) + col("inside", name)
            choose = lambda before, here, behind, now, r=rank, u=under, o=over, n=name: (
                F.when(~wide(n), now).when(r < u, before).when(r < o, here).otherwise(behind)
            )
            narrowed[f"low_{name}"] = choose(col("low", name), col("from", name), col("to", name) + 1, col("low", name))
            narrowed[f"high_{name}"] = choose(col("from", name) - 1, col("to", name), col("high", name), col("high", name))
            narrowed[f"below_{name}"] = choose(col("below", name), under, over, col("below", name))
            narrowed[f"inside_{name}"] = choose(under - col("below", name), col("among", name), end - over, col("inside", name))
        later = counted.withColumns(narrowed).select(*state.columns)
        state = materialized(later.unionByName(state.where(~any_wide())), "brackets")

    found = state.select(*keys, "n")
    if not ranks:
        return found
    met = joined_on(rows, broadcast_if_small(state), keys)
    wanted = [
        F.when(
            F.col("v").between(col("low", name), col("high", name)),
            F.struct(F.lit(name).alias("name"), (col("rank", name) - col("below", name)).alias("at")),
        )
        for name in ranks
    ]
    inside = met.select(*keys, "v", F.explode(F.array_compact(F.array(*wanted))).alias("w")).groupBy(*keys, "w", "v").agg(F.count("*").alias("copies"))
    upto = F.sum("copies").over(W.partitionBy(*keys, "w").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    here = inside.withColumn("upto", upto).where((F.col("w.at") >= F.col("upto") - F.col("copies")) & (F.col("w.at") < F.col("upto")))
    values = here.groupBy(*keys).agg(*[F.max(F.when(F.col("w.name") == name, F.col("v"))).alias(name) for name in ranks])
    return joined_on(found, values, keys, "left").select(*keys, "n", *ranks)
