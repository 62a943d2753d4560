"""Exact quantiles per group by refinement: sketches choose brackets, counts prove them, only brackets are ordered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticewing.plans.storage import written

#: different values strictly inside a bracket that are ordered by one task at most
MOST = 1 << 18
#: size of a quantile sketch; its rank error is about 0.3 % of the values it has seen
SKETCH = 1024
#: a sketch is read at this many steps, of which a bracket keeps SPARE on either side of the wanted rank
GRID, SPARE = 200, 2
_LEAST, _GREATEST = float("-inf"), float("nan")


def _sketch() -> Column:
    # The sketch leaves NaN out, which Spark orders behind all numbers.
    return F.kll_sketch_agg_double(F.when(~F.isnan("v"), F.col("v")), SKETCH)


def _around(sketch: Column, known: Column, rank: Column) -> tuple[Column, Column]:
    """Bracket around a 1-based rank among the values of a sketch, `known` of which are numbers."""
    grid = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    step = rank / known * GRID

    def at(x: Column) -> Column:
        return F.element_at(grid, F.greatest(F.lit(0), F.least(F.lit(GRID), x.cast("int"))) + 1)

    return (
        F.when(known == 0, _LEAST).otherwise(at(F.floor(step) - SPARE)),
        F.when((known == 0) | (rank > known), _GREATEST).otherwise(at(F.ceil(step) + SPARE)),
    )


def _bounds(state: DataFrame, n: int) -> DataFrame:
    """One row per group with the ends of its n brackets as columns, so that rows are not multiplied."""
    ends = [F.max(F.when(F.col("i") == k, F.col(e))).alias(f"{e}{k}") for k in range(n) for e in ("lo", "hi")]
    return state.groupBy(F.col("_by").alias("_g")).agg(*ends)


def _counted(base: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """`state` with how many values of the group lie before, up to, before the end and up to the end of each bracket."""
    v = F.col("v")
    tests = {"lt_lo": lambda k: v < F.col(f"lo{k}"), "le_lo": lambda k: v <= F.col(f"lo{k}"),
             "lt_hi": lambda k: v < F.col(f"hi{k}"), "le_hi": lambda k: v <= F.col(f"hi{k}")}
    sums = [F.count_if(test(k)).alias(f"{name}{k}") for k in range(n) for name, test in tests.items()]
    per_group = base.join(_bounds(state, n), F.col("_by").eqNullSafe(F.col("_g"))).groupBy("_g").agg(*sums)
    each = F.array(*[F.struct(F.lit(k).alias("_i"), *[F.col(f"{name}{k}").alias(name) for name in tests]) for k in range(n)])
    long = per_group.select("_g", F.explode(each).alias("c")).select("_g", "c.*")
    same = F.col("_by").eqNullSafe(F.col("_g")) & (F.col("i") == F.col("_i"))
    return state.drop(*tests).join(long, same).drop("_g", "_i")


def _inside(base: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """Values of the brackets of `state`: (_by, i, v)."""
    v = F.col("v")
    hits = F.array(*[F.when((v >= F.col(f"lo{k}")) & (v <= F.col(f"hi{k}")), k) for k in range(n)])
    joined = base.join(_bounds(state, n), F.col("_by").eqNullSafe(F.col("_g")))
    return joined.select("_by", "v", F.explode(F.array_compact(hits)).alias("i"))


def brackets(base: DataFrame, ranks: Sequence[tuple[Column, int]]) -> DataFrame:
    """One row per group of `base` (_by, v) and wanted rank: _by, i, r, lo, hi, lt_lo and more counts.

    Each bracket holds its rank, which counts over all values have proved, and strictly inside it
    at most MOST values. `ranks` are expressions of `n`, the group's size.
    """
    n = len(ranks)
    first = written(base.groupBy("_by").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.isnan("v")).alias("known"), _sketch().alias("sketch")))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), r.cast("long").alias("r")) for r, i in ranks]))
    low, high = _around(F.col("sketch"), F.col("known"), F.col("r"))
    state = first.select("_by", "n", "known", "sketch", wanted.alias("w")).select("_by", "n", "known", "sketch", "w.*").select(
        "_by", "i", "n", "r", low.alias("lo"), high.alias("hi"))
    done: DataFrame | None = None
    while True:
        state = written(_counted(base, state, n))
        holds = (F.col("lt_lo") < F.col("r")) & (F.col("r") <= F.col("le_hi"))
        small = holds & (F.col("lt_hi") - F.col("le_lo") <= MOST)
        fine = state.where(small)
        done = fine if done is None else done.unionByName(fine)
        wide = state.where(~small)
        if wide.isEmpty():
            return done
        # A bracket that missed its rank gives way to all values on that side.
        side = wide.withColumns({
            "lo": F.when(F.col("r") <= F.col("lt_lo"), _LEAST).when(F.col("r") > F.col("le_hi"), F.col("hi")).otherwise(F.col("lo")),
            "hi": F.when(F.col("r") <= F.col("lt_lo"), F.col("lo")).when(F.col("r") > F.col("le_hi"), _GREATEST).otherwise(F.col("hi")),
            "before": F.when(F.col("r") <= F.col("lt_lo"), 0).when(F.col("r") > F.col("le_hi"), F.col("lt_hi")).otherwise(F.col("lt_lo")),
        }).select("_by", "i", "n", "r", "lo", "hi", "before")
        seen = _inside(base, side, n).groupBy(F.col("_by").alias("_g"), F.col("i").alias("_i")).agg(
            F.count_if(~F.isnan("v")).alias("known"), _sketch().alias("sketch"))
        low, high = _around(F.col("sketch"), F.col("known"), F.col("r") - F.col("before"))
        # Written before it is used twice: a sketch made again may give other ends.
        state = written(side.join(seen, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("i") == F.col("_i"))).select(
            "_by", "i", "n", "r", low.alias("lo"), high.alias("hi")))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: str | None = None) -> DataFrame:
    """(`by`, prob, quantile): linearly interpolated quantiles of a numeric column, exact.

    Every pass adds up in the tasks: a sketch per group chooses a bracket around each wanted
    rank, counts say whether the rank lies in it, and brackets with more than MOST values are narrowed
    by a sketch of their own values. Only different values inside the last brackets are shuffled and
    ordered, so neither a far value nor a narrow group fills a task. Nulls are left out, NaN is the
    largest value, a null `by` is a group, an empty table gives no rows. `df` is read once: its groups and values
    are written, so that every pass sees the same ones.
    """
    group = F.lit(0) if by is None else F.col(f"`{by}`")
    base = written(df.select(group.alias("_by"), F.col(f"`{value}`").cast("double").alias("v")).where(F.col("v").isNotNull()))
    places = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ranks = [(f(place) + 1, 2 * k + side) for k, place in enumerate(places) for side, f in enumerate((F.floor, F.ceil))]
    state = brackets(base, ranks)
    counted = _inside(base, state, len(ranks)).groupBy("_by", "i", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy("_by", "i").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    there = state.select(F.col("_by").alias("_g"), F.col("i").alias("_i"), "n", "r", "lt_lo")
    ranked = counted.withColumn("upto", upto).join(there, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("i") == F.col("_i")))
    after = F.col("lt_lo") + F.col("upto")
    hit = ranked.where((after >= F.col("r")) & (after - F.col("c") < F.col("r"))).select("_by", "n", "v", F.shiftright("i", 1).alias("p"), (F.col("i") % 2).alias("side"))
    pair = hit.groupBy("_by", "n", "p").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("high"))
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("p") + 1)
    place = (F.col("n") - 1) * prob
    out = pair.select("_by", prob.alias("prob"), F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
        F.col("low") + (place - F.floor(place)) * (F.col("high") - F.col("low"))).alias("quantile"))
    return out.drop("_by") if by is None else out.withColumnRenamed("_by", by)
