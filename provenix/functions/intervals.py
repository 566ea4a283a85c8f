"""Half-open time intervals [start, end) by key: merge, complement, clip, audit, point lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(gaps: DataFrame, keys: list[str], start: str = "gap_start", end: str = "gap_end") -> DataFrame:
    """Merges overlapping and abutting intervals; empty ones (end not after start) are left out, see ``refused``."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = gaps.where(F.col(end) > F.col(start)).withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_merged")).drop("_island")


def refused(gaps: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals that are empty or lie outside their window: input errors of the strict merge."""
    own = gaps.drop("window_start", "window_end").join(windows.select(*keys, "window_start", "window_end"), keys)
    empty, out = F.col("gap_end") <= F.col("gap_start"), (F.col("gap_start") < F.col("window_start")) | (F.col("gap_end") > F.col("window_end"))
    return own.withColumn("reason", F.when(empty, "empty_interval").when(out, "outside_window")).where("reason is not null")


def complement(windows: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """The covered parts of each window: what its merged gaps leave. A window without gaps is covered whole."""
    marks = merged.select(*keys, F.col("gap_start").alias("s"), F.col("gap_end").alias("e"))
    edges = marks.unionByName(windows.select(*keys, F.col("window_start").alias("s"), F.col("window_start").alias("e"))).unionByName(windows.select(*keys, F.col("window_end").alias("s"), F.col("window_end").alias("e")))
    order = Window.partitionBy(*keys).orderBy("s", "e")
    return edges.withColumn("covered_start", F.lag("e").over(order)).where("covered_start < s").select(*keys, "covered_start", F.col("s").alias("covered_end"))


def clip(gaps: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps cut to their window; one wholly outside is marked, not dropped."""
    own = gaps.drop("window_start", "window_end").join(windows.select(*keys, "window_start", "window_end"), keys)
    s, e = F.greatest("gap_start", "window_start"), F.least("gap_end", "window_end")
    return own.withColumn("outside", s >= e).withColumn("clip_start", F.when(~F.col("outside"), s)).withColumn("clip_end", F.when(~F.col("outside"), e))


def partition_audit(windows: DataFrame, merged: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Whether gaps and covered parts tile each window: no hole, no overlap, durations that add up (microseconds)."""
    parts = merged.select(*keys, F.col("gap_start").alias("s"), F.col("gap_end").alias("e"), F.lit(1).alias("gap")).unionByName(covered.select(*keys, F.col("covered_start").alias("s"), F.col("covered_end").alias("e"), F.lit(0).alias("gap")))
    order = Window.partitionBy(*keys).orderBy("s", "e")
    length = F.unix_micros("e") - F.unix_micros("s")
    step = parts.withColumn("_next", F.lead("s").over(order))
    got = step.groupBy(*keys).agg(
        F.sum(F.when(F.col("gap") == 1, length).otherwise(0)).alias("gap_us"), F.sum(F.when(F.col("gap") == 0, length).otherwise(0)).alias("covered_us"),
        F.coalesce(F.bool_and(F.col("_next") == F.col("e")), F.lit(True)).alias("joined"), F.min("s").alias("_s"), F.max("e").alias("_e"),
    )
    whole = F.unix_micros("window_end") - F.unix_micros("window_start")
    return windows.join(got, keys, "left").select(
        *keys, "gap_us", "covered_us", whole.alias("window_us"),
        (F.col("joined") & (F.col("_s") == F.col("window_start")) & (F.col("_e") == F.col("window_end")) & (F.col("gap_us") + F.col("covered_us") == whole)).alias("tiled"),
    )


#: The tree of time blocks: cells of a minute from year 0 on, blocks of 8**level cells.
CELL, ZERO, LEVELS = 60_000_000, 62_167_219_200_000_000, 11
FOREVER = "9999-12-31 23:59:59.999999"


def _cell(at: F.Column) -> F.Column:
    return F.call_function("div", F.unix_micros(at) + ZERO, F.lit(CELL))


def blocks(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Each interval once for each of the few blocks (_level, _block) that tile its cells: at most 14 a level, whatever its length; 15 minutes take a few, five years about 50. A null end lies in year 9999."""
    last = F.coalesce(F.col(end), F.lit(FOREVER).cast("timestamp"))
    cut = intervals.where(last > F.col(start)).withColumn("_a", _cell(F.col(start))).withColumn("_b", _cell(last - F.expr("interval 1 microsecond")) + 1)
    # at level k whole blocks lie from ceil(a / 8^k) to floor(b / 8^k); those that make up whole blocks of the next level are left to it
    tiles = F.expr(f"""flatten(transform(sequence(0, {LEVELS - 1}), k -> transform(
        case when (_a + shiftleft(1L, 3 * k) - 1) div shiftleft(1L, 3 * k) >= _b div shiftleft(1L, 3 * k) then cast(array() as array<bigint>)
             when k = {LEVELS - 1} or (_a + shiftleft(8L, 3 * k) - 1) div shiftleft(8L, 3 * k) >= _b div shiftleft(8L, 3 * k) then sequence((_a + shiftleft(1L, 3 * k) - 1) div shiftleft(1L, 3 * k), _b div shiftleft(1L, 3 * k) - 1)
             else concat(slice(sequence((_a + shiftleft(1L, 3 * k) - 1) div shiftleft(1L, 3 * k), 8 * ((_a + shiftleft(8L, 3 * k) - 1) div shiftleft(8L, 3 * k))), 1, 8 * ((_a + shiftleft(8L, 3 * k) - 1) div shiftleft(8L, 3 * k)) - (_a + shiftleft(1L, 3 * k) - 1) div shiftleft(1L, 3 * k)),
                         slice(sequence(8 * (_b div shiftleft(8L, 3 * k)), _b div shiftleft(1L, 3 * k)), 1, _b div shiftleft(1L, 3 * k) - 8 * (_b div shiftleft(8L, 3 * k)))) end,
        x -> named_struct('_level', k, '_block', x))))""")
    return cut.withColumn("_t", F.explode(tiles)).select(*intervals.columns, "_t._level", "_t._block")


def probes(points: DataFrame, at: str, levels: list[int]) -> DataFrame:
    """Each point once for each level: the block that it lies in."""
    level = F.explode(F.array(*(F.lit(k) for k in levels)).cast("array<int>"))
    return points.where(F.col(at).isNotNull()).withColumn("_level", level).withColumn("_block", F.expr(f"({_CELL_SQL.format(at=at)}) div shiftleft(1L, 3 * _level)"))


_CELL_SQL = f"(unix_micros({{at}}) + {ZERO}) div {CELL}"


def used_levels(tiles: DataFrame) -> list[int]:
    """The levels that occur, LEVELS at most; points are looked up at these only."""
    return sorted(r[0] for r in tiles.select("_level").distinct().collect())


def inside(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str = "gap_start", end: str = "gap_end", merged: bool = True) -> DataFrame:
    """Points that lie in an interval, each once. Intervals of a key must not overlap (``merged``), or are merged first; a null end is open.

    Equi-join on keys and block of time: a busy key is spread over its blocks, and an interval costs a few rows however long it is.
    """
    own = intervals.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    if not merged:
        own = merge(own.withColumn("_e", F.coalesce("_e", F.lit(FOREVER).cast("timestamp"))), keys, "_s", "_e").drop("n_merged")
    tiles = blocks(own, "_s", "_e")
    p, s = probes(points, at, used_levels(tiles)).alias("p"), tiles.alias("s")
    cond = (F.col(f"p.{at}") >= F.col("s._s")) & (F.col("s._e").isNull() | (F.col(f"p.{at}") < F.col("s._e")))
    for k in [*keys, "_level", "_block"]:
        cond = cond & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    return p.join(s, cond, "left_semi").drop("_level", "_block")  # of the tiles of one interval a point lies in one
