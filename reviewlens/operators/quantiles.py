"""Quantile expressions and the distributed exact quantile operator.

``percentile`` is exact with linear interpolation (pandas / numpy ``linear``), but it keeps
a value → count map per group and merges every partial map in the one task that finalises
the group. Its state therefore grows with the number of *distinct* values: fine for bounded
domains (ratings, pre-counted text lengths), not for arbitrary doubles at scale. For those,
``group_summary`` brackets each rank with a quantile sketch and ranks only what is inside.
``accuracy`` selects ``percentile_approx`` instead (rank error ≤ 1/accuracy).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.session import staged

#: Size parameter of the sketch (KLL): its rank error is about ``2.3 / SKETCH ** 0.9`` with 99 % confidence.
SKETCH = 32_768
#: Half a bracket, in ranks as a part of all values: four such errors, and what small groups need for the rank beside.
MARGIN = 4 * 2.296 / SKETCH ** 0.9021 + 1e-4
#: Groups of at most so many values are ranked whole.
SMALL = 20_000
#: Steps into which a bracket is cut, so that only the steps that hold a rank are sorted.
STEPS = 1024


def quantile_exprs(v: Column, probs: Sequence[float], accuracy: int | None = None) -> Column:
    """Array of quantiles of ``v`` (exact by default); for bounded value domains."""
    v = v.cast("double")
    if accuracy is None:
        return F.percentile(v, list(probs))
    return F.percentile_approx(v, list(probs), accuracy)


def _same(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`_k_{k}`"))
    return on


def _keyed(df: DataFrame, keys: list[str], *rest: str) -> DataFrame:
    return df.select(*[F.col(f"`{k}`").alias(f"_k_{k}") for k in keys], *rest)


def _place(n: int) -> tuple[Column, Column, Column]:
    """``(brackets below, inside one, step in it)`` of ``v``, from columns ``b0, t0, b1, t1, ...`` (ends of the brackets in order)."""
    v = F.col("v")
    below = sum(((F.col(f"t{j}") < v).cast("int") for j in range(n)), F.lit(0))
    inside, step = F.lit(False), F.lit(0)
    for j in reversed(range(n)):
        b, t = F.col(f"b{j}"), F.col(f"t{j}")
        here = (v >= b) & (v <= t)
        inside = inside | here
        at = F.floor(F.try_divide(v / 2 - b / 2, t / 2 - b / 2) * STEPS)
        step = F.when(here, F.least(F.coalesce(at, F.lit(0)).cast("int"), F.lit(STEPS - 1))).otherwise(step)
    return below, inside.cast("int"), step


def group_summary(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """A row per group: ``(*keys, n, mean, std, low, high, q)``, ``q`` the exact quantiles (null, and ``n`` 0, without a value).

    Quantiles interpolate linearly, as pandas and Spark's ``percentile`` do; NULL and NaN are
    skipped; ``std`` is the sample's. Two reads of ``df``, whatever it holds and however many
    groups there are:

    1. One aggregation gives count, moments, ends and a quantile sketch of each group, and so
       a bracket of values around each wanted rank (all of a small group).
    2. One aggregation counts what lies between the brackets, and inside them each value; a
       hot value is one row per task, and so is all that lies outside.

    The counts, a small part of the input, are written to the shared folder. Running sums over
    the steps of each bracket tell which step holds a rank; only its values are sorted. A
    bracket that misses its rank (its margin is four times the sketch's error) is an error,
    never a wrong answer.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    order = sorted(set(probs))
    n = len(order)
    v = F.col(f"`{value}`").cast("double")
    d = df.select(*[F.col(f"`{k}`") for k in keys], F.nanvl(v, F.lit(None).cast("double")).alias("v"))
    if not keys:  # one group
        d, keys, single = d.withColumn("_all", F.lit(0)), ["_all"], True
    else:
        single = False
    sketch = F.kll_sketch_agg_double("v", F.lit(SKETCH))
    cuts = [x for p in order for x in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))]
    stats = (d.groupBy(*keys).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("low"),
                                  F.max("v").alias("high"), F.when(F.count("v") > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(cuts))).alias("cuts")))
    whole = F.col("n") <= SMALL
    for j, p in enumerate(order):
        stats = stats.withColumns({
            f"b{j}": F.when(whole | F.lit(p - MARGIN <= 0), F.col("low")).otherwise(F.col("cuts")[2 * j]),
            f"t{j}": F.when(whole | F.lit(p + MARGIN >= 1), F.col("high")).otherwise(F.col("cuts")[2 * j + 1])})
    stats = staged(stats.drop("cuts"), "quantile-brackets")
    ends = [c for j in range(n) for c in (f"b{j}", f"t{j}")]
    below, inside, step = _place(n)
    near = d.where(F.col("v").isNotNull()).join(_keyed(stats, keys, *ends), _same(keys)).select(
        *[F.col(f"`{k}`") for k in keys], below.alias("below"), inside.alias("inside"), F.col("v"), step.alias("step"))
    counted = near.select(*[F.col(f"`{k}`") for k in keys], "below", "inside", F.when(F.col("inside") == 1, F.col("step")).otherwise(0).alias("step"),
                          F.when(F.col("inside") == 1, F.col("v")).alias("v")).groupBy(*keys, "below", "inside", "step", "v").agg(F.count(F.lit(1)).alias("c"))
    counted = staged(counted, "quantile-counts")

    pos = [F.lit(p) * (F.col("n") - 1) for p in order]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in pos for f in (F.floor, F.ceil)]))
    steps = counted.groupBy(*keys, "below", "inside", "step").agg(F.sum("c").alias("c"))
    up_to = Window.partitionBy(*keys).orderBy("below", "inside", "step").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("before", F.sum("c").over(up_to) - F.col("c"))
    within = lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("c"))
    steps = (steps.join(_keyed(stats.withColumn("ranks", ranks), keys, "ranks"), _same(keys))
             .withColumn("ranks", F.filter("ranks", within)).where(F.size("ranks") > 0)
             .select(*[F.col(f"`{k}`").alias(f"_k_{k}") for k in keys], F.col("below").alias("_below"), F.col("inside").alias("_inside"),
                     F.col("step").alias("_step"), "before", "ranks"))
    on = _same(keys) & (F.col("below") == F.col("_below")) & (F.col("inside") == F.col("_inside")) & (F.col("step") == F.col("_step"))
    last = counted.join(steps, on)
    along = Window.partitionBy(*keys, "below", "inside", "step").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("before", F.col("before") + F.sum("c").over(along) - F.col("c"))
    found = (last.select(*[F.col(f"`{k}`") for k in keys], "v", F.explode(F.filter("ranks", within)).alias("rank"))
             .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", F.struct("v")))).alias("at")))
    out = stats.join(_keyed(found, keys, "at"), _same(keys), "left")
    missed = F.raise_error(F.lit("a quantile is outside its bracket")).cast("double")

    def quantile(p: float) -> Column:
        x = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.floor(x).cast("long"), F.ceil(x).cast("long")
        a, b = F.col("at")[lo]["v"], F.col("at")[hi]["v"]
        mixed = F.when((lo == hi) | (a == b), a).otherwise((hi - x) * a + (x - lo) * b)
        return F.when(a.isNull() | b.isNull(), missed).otherwise(mixed)

    return out.select(*([] if single else [F.col(f"`{k}`") for k in keys]), "n", "mean", "std", "low", "high",
                      F.when(F.col("n") > 0, F.array(*[quantile(p) for p in probs])).alias("q"))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles: rows ``(*keys, p, value)`` (see ``group_summary``)."""
    probs = [float(p) for p in probs]
    each = group_summary(df, keys, value, probs).where(F.col("n") > 0).select(*[F.col(f"`{k}`") for k in keys], F.posexplode("q").alias("_i", "value"))
    return each.select(*[F.col(f"`{k}`") for k in keys], F.element_at(F.lit(probs), F.col("_i") + 1).alias("p"), "value")


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of one column: rows ``(p, value)`` (see ``group_summary``)."""
    return group_quantiles(df, [], col, probs)


def wide_summary(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``group_summary`` of several columns in the same two reads: a row ``(column_name, n, ..., q)`` per column (none without rows).

    The columns are unpivoted into ``(column index, v)`` pairs; an integer key hashes cheaper
    than the name, which is attached to the few result rows.
    """
    columns = list(columns)
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_ci"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)])))
    names = F.array(*[F.lit(c) for c in columns])
    return group_summary(long, ["_ci"], "v", probs).withColumn("column_name", F.element_at(names, F.col("_ci") + 1)).drop("_ci")


def wide_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of several columns: rows ``(column_name, p, value)`` (see ``wide_summary``)."""
    probs = [float(p) for p in probs]
    return wide_summary(df, columns, probs).where(F.col("n") > 0).select("column_name", F.posexplode("q").alias("_i", "value")).select(
        "column_name", F.element_at(F.lit(probs), F.col("_i") + 1).alias("p"), "value")
