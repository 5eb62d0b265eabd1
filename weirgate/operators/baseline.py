"""Silent baselines: statistics by entity, and scores that are recorded as rows and never sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import keep
from .neighbours import with_neighbour


def rollup(df: DataFrame, entity: str, ts: str, period: str, metric: str) -> DataFrame:
    """``entity, period, n, total`` by tumbling period; money is summed as decimal."""
    return df.groupBy(entity, F.window(ts, period).getField("start").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(metric).cast("decimal(18,2)")).cast("double").alias("total"))


def zero_fill(rolled: DataFrame, entities: DataFrame, entity: str, first: str, last: str, step: str = "1 day") -> DataFrame:
    """A row for each entity and period; periods without rows have 0.

    A null entity is one like others. Rows of ``rolled`` at other times than the
    calendar's, or of other entities than ``entities``, are not in the result.
    """
    grid = entities.select(F.col(entity).alias("_e")).distinct().select("_e", F.explode(F.expr(f"sequence(timestamp_ntz'{first}', timestamp_ntz'{last}', interval {step})")).alias("_p"))
    full = grid.join(rolled, F.col("_e").eqNullSafe(F.col(entity)) & (F.col("_p") == F.col("period")), "left")
    return full.select(F.col("_e").alias(entity), F.col("_p").alias("period"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def fit(df: DataFrame, by: list[str | Column], metric: str) -> DataFrame:
    """``n, mean, sd`` by entity; the sd of one row is null."""
    return df.groupBy(*by).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"))


def fit_seasonal(df: DataFrame, entity: str, season: Column, metric: str) -> DataFrame:
    return fit(df, [entity, season.alias("season")], metric)


def fit_trailing(rolled: DataFrame, entity: str, k: int, metric: str = "n", period_seconds: int = 86_400) -> DataFrame:
    """Mean and sd of the ``k`` periods before each; the own one is not in. Periods without a row don't count: fill them first to count them as 0."""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', period)")
    w = Window.partitionBy(entity).orderBy(seconds).rangeBetween(-k * period_seconds, -1)
    return rolled.select("*", F.avg(metric).over(w).alias("mean"), F.stddev_samp(metric).over(w).alias("sd"))


#: Cells of values to each doubling; only the cells that may hold a quantile are sorted.
CELLS = 2048


def _values(df: DataFrame, entity: str, metric: str) -> DataFrame:
    """``_e, _v, _c``: values that are neither null nor NaN, with their cells, which rise with the values."""
    value = F.col("_v")
    size = F.floor(F.log2(F.abs(value)) * CELLS).cast("int") + 1075 * CELLS + 1  # the smallest double is 2^-1074
    cell = F.when(value == 0, 0).when(F.abs(value) == float("inf"), F.signum(value).cast("int") * 2**30).otherwise(F.signum(value).cast("int") * size)
    values = df.select(F.col(entity).alias("_e"), F.col(metric).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    return values.withColumn("_c", cell)


def _cells(values: DataFrame) -> DataFrame:
    """``_e, _c, _n, _lo, _hi``: the histogram of each entity; tasks' counts are merged, so values don't go through the shuffle."""
    return values.groupBy("_e", "_c").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))


def _inside(values: DataFrame, few: DataFrame) -> DataFrame:
    """The values of some cells, with what ``few`` says of a cell."""
    few = few.withColumnsRenamed({"_e": "_w", "_c": "_k"})
    return values.join(few, F.col("_e").eqNullSafe(F.col("_w")) & (F.col("_c") == F.col("_k"))).drop("_w", "_k")


def _at_ranks(inside: DataFrame, ps: dict[str, float], *more: str) -> DataFrame:
    """``_e``, ``more`` and the quantiles: from ``_v`` of the cells where they fall and how many values are before these."""
    counts = inside.groupBy("_e", "_part", "_before", "_all", *more, "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_e", "_part").orderBy("_v")) + F.col("_before")
    ranked = counts.select("_e", "_all", *more, "_v", (upto - F.col("_n")).alias("_from"), upto.alias("_to"))
    place = {name: F.lit(float(p)) * (F.col("_all") - 1) for name, p in ps.items()}
    at = lambda rank: F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_to")), F.col("_v")))
    ends = ranked.groupBy("_e", "_all", *more).agg(*(at(f(x)).alias(f"{side}_{name}") for name, x in place.items() for side, f in (("_a", F.floor), ("_b", F.ceil))))
    between = lambda name, x: F.col(f"_a_{name}") + F.when(x > F.floor(x), (x - F.floor(x)) * (F.col(f"_b_{name}") - F.col(f"_a_{name}"))).otherwise(0.0)
    return ends.select("_e", *more, *(between(name, x).alias(name) for name, x in place.items()))


def _quantiles(values: DataFrame, cells: DataFrame, ps: dict[str, float]) -> DataFrame:
    """``_e`` and the quantiles ``ps``."""
    placed = cells.withColumns({"_before": F.sum("_n").over(Window.partitionBy("_e").orderBy("_c")) - F.col("_n"), "_all": F.sum("_n").over(Window.partitionBy("_e"))})
    wanted = F.lit(False)
    for p in ps.values():
        for f in (F.floor, F.ceil):
            rank = f(F.lit(float(p)) * (F.col("_all") - 1))
            wanted = wanted | ((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n")))
    few = placed.where(wanted).select("_e", "_c", F.col("_c").alias("_part"), "_before", "_all")
    return _at_ranks(_inside(values, few), ps)


def fit_quantiles(df: DataFrame, entity: str, metric: str, ps: dict[str, float]) -> DataFrame:
    """``entity`` and a column for each name in ``ps``: exact quantiles, between two values by their distance.

    One scan counts values by cells whose bounds are the same everywhere, so
    counts of tasks merge; a second takes the values of the cells where quantiles
    fall. No task holds or sorts all values of an entity. Nulls and NaN don't
    count; an entity without values has no row, a null one is one like others.
    """
    values = _values(df, entity, metric)
    return _quantiles(values, _cells(values), ps).withColumnRenamed("_e", entity)


def fit_robust(df: DataFrame, entity: str, metric: str) -> DataFrame:
    """``median, mad`` by entity, exact, in three scans: counts of cells, the cells of the median, the cells of the deviation.

    Once the median is known, a cell's least and greatest value bound the
    deviations in it. Cells beyond the bounds of the middle deviation need no
    look. The cells' counts are written to the shared folder.
    """
    values = _values(df, entity, metric)
    cells = keep(_cells(values))
    median = _quantiles(values, cells, {"median": 0.5}).withColumnRenamed("_e", "_m")
    off = cells.join(median, F.col("_e").eqNullSafe(F.col("_m")))
    low, high = F.col("_lo") - F.col("median"), F.col("_hi") - F.col("median")
    off = off.withColumns({"_near": F.when(low > 0, low).when(high < 0, -high).otherwise(0.0), "_far": F.greatest(F.abs(low), F.abs(high))})
    each = Window.partitionBy("_e")
    by = lambda c: F.sum("_n").over(each.orderBy(c).rangeBetween(Window.unboundedPreceding, 0))
    off = off.withColumns({"_all": F.sum("_n").over(each), "_may": by("_near"), "_must": by("_far")})
    rank = F.lit(0.5) * (F.col("_all") - 1)
    # So many values are sure to be as near, and so many at most.
    off = off.withColumns({"_least": F.min(F.when(F.col("_may") > F.floor(rank), F.col("_near"))).over(each), "_most": F.min(F.when(F.col("_must") > F.ceil(rank), F.col("_far"))).over(each)})
    off = off.withColumn("_before", F.sum(F.when(F.col("_far") < F.col("_least"), F.col("_n")).otherwise(0)).over(each))
    few = off.where("_near <= _most AND _far >= _least").select("_e", "_c", F.lit(0).alias("_part"), "_before", "_all", "median")
    inside = _inside(values, few).withColumn("_v", F.abs(F.col("_v") - F.col("median")))
    return _at_ranks(inside, {"mad": 0.5}, "median").select(F.col("_e").alias(entity), "median", "mad")


def score(df: DataFrame, baseline: DataFrame, entity: str, metric: str, k: float) -> DataFrame:
    """``df`` with ``z, flagged``; z is null where the sd is null or 0, or the baseline lacks the entity, and then nothing is flagged.

    A null entity is one like others. Columns of ``df`` named ``z`` or
    ``flagged`` are replaced, others come through whatever their names. The
    baseline has a row for each entity.
    """
    stats = baseline.select(F.struct(F.col(entity).alias("entity"), "mean", "sd").alias("_baseline"))
    others = [c for c in df.columns if c not in ("z", "flagged")]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row"))
    value, sd = F.col(f"_row.`{metric}`"), F.col("_baseline.sd")
    z = F.when(sd > 0, (value - F.col("_baseline.mean")) / sd)
    out = rows.join(stats, F.col(f"_row.`{entity}`").eqNullSafe(F.col("_baseline.entity")), "left")
    return out.select(*(F.col(f"_row.`{c}`") for c in others), z.alias("z"), F.coalesce(F.abs(z) > k, F.lit(False)).alias("flagged"))


def shadow_sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """``threshold, n_flagged``: how many rows each threshold would have flagged."""
    one = scores.agg(*(F.count_if(F.abs("z") > t).alias(f"_{i}") for i, t in enumerate(thresholds)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("n_flagged")) for i, t in enumerate(thresholds)))))


def drift(before: DataFrame, after: DataFrame, entity: str, metric: str, width: float, bins: int) -> DataFrame:
    """``entity, psi`` between two histograms of ``bins`` bins, the first and the last open, with half a row added to each. Null values don't count; a null entity is one like others."""
    before, after = (x.where(F.col(metric).isNotNull()) for x in (before, after))
    b = F.greatest(F.least(F.floor(F.col(metric) / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    rows = before.select(entity, b.alias("bin"), F.lit(0).alias("side")).unionByName(after.select(entity, b.alias("bin"), F.lit(1).alias("side")))
    counts = rows.groupBy(entity, "bin").agg(F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("q"))
    grid = rows.select(F.col(entity).alias("_e")).distinct().select("_e", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_b"))
    full = grid.join(counts, F.col("_e").eqNullSafe(F.col(entity)) & (F.col("_b") == F.col("bin")), "left").select(F.col("_e").alias(entity), (F.coalesce("p", F.lit(0)) + 0.5).alias("p"), (F.coalesce("q", F.lit(0)) + 0.5).alias("q"))
    w = Window.partitionBy(entity)
    share = full.select(entity, (F.col("p") / F.sum("p").over(w)).alias("p"), (F.col("q") / F.sum("q").over(w)).alias("q"))
    return share.groupBy(entity).agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))


def silence(df: DataFrame, entity: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """``entity, last_seen, seen_again``: gaps between reports longer than ``seconds``. A hot entity is sorted by days."""
    rows = df.select(F.col(entity).alias("entity"), F.col(ts).alias("ts"), F.col(tie).alias("tie"))
    gaps = with_neighbour(rows, "entity", ["ts", "tie"], F.struct("ts"), F.to_date("ts"))
    gaps = gaps.select(F.col("entity").alias(entity), F.col("_beside.ts").alias("last_seen"), F.col("ts").alias("seen_again"))
    return gaps.where(F.col("seen_again") > F.col("last_seen") + F.expr(f"interval {seconds} seconds"))


def sessions(df: DataFrame, entity: str, ts: str, gap: str, cell: Column | None = None) -> DataFrame:
    """``entity, session_start, n``; a gap of exactly ``gap`` stays in the session.

    Rows are sorted within cells of time, days or ``cell``, which must not fall
    as ``ts`` rises. That gives partial sessions (first and last time, number of
    rows); only the first and last one of each cell may go on in another, and
    those alone are put in order by entity and stitched. So a hot entity is
    dealt over as many tasks as it has cells. Rows without a time are left out;
    a null entity is one like others.
    """

    def numbered(rows: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
        by = Window.partitionBy(*keys).orderBy(first)
        rows = rows.withColumn("_new", F.coalesce(F.col(first) > F.lag(last).over(by) + F.expr(f"interval {gap}"), F.lit(True)).cast("bigint"))
        return rows.withColumn("_s", F.sum("_new").over(by))

    rows = df.select(F.col(entity).alias("_e"), F.col(ts).alias("_t"), (F.to_date(ts) if cell is None else cell).alias("_c")).where("_t IS NOT NULL")
    parts = numbered(rows, ["_e", "_c"], "_t", "_t").groupBy("_e", "_c", "_s").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.count(F.lit(1)).alias("_n"))
    at_end = (F.col("_s") == 1) | (F.col("_s") == F.max("_s").over(Window.partitionBy("_e", "_c")))
    # Those between the ends of a cell stay by themselves: numbered by cell, each is new.
    parts = parts.select("_e", F.when(~at_end, F.col("_c")).alias("_own"), "_first", "_last", "_n")
    stitched = numbered(parts, ["_e", "_own"], "_first", "_last").groupBy("_e", "_own", "_s").agg(F.min("_first").alias("session_start"), F.sum("_n").alias("n"))
    return stitched.select(F.col("_e").alias(entity), "session_start", "n")
