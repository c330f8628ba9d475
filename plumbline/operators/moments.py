"""Statistics of many time ranges from cells that were added up before: minutes, hours and days.

A cell holds, for each value column, the number, mean, sum of squared deviations, least and greatest of its readings, and for
each flag how many have it. Cells merge, hours from minutes and days from hours, so readings are read once, whatever ranges are
asked for. Up to ``FEW`` ranges are taken apart: a range is whole days, the hours and minutes around them, and the readings in
the two minutes that it cuts: some 170 cells and two minutes at most besides its days.

More ranges are two rows each, however long they are. The minutes of both ends differ first in some bit; there a block of
2^level minutes ends and the next one begins. The range is what is left of the one block from its start on, and what the other
holds up to its end. Either is a part of a minute, a running aggregate that all ends in the minute share, and whole
minutes, a row of cells merged once for all ranges that begin (or end) in that minute and meet at that level. So work grows
with readings plus ranges, not with readings a minute times ranges, and nothing is taken off again: aggregates only merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.readings import parse_ranges
from plumbline.sources.shared import materialize

LEVELS = {"minute": 60, "hour": 3600, "day": 86_400}
#: Range tables up to this many rows are taken apart into cells.
FEW = 10_000
#: Added to minutes since 1970, so that none is negative; blocks of up to 2^31 minutes stay where they are.
ORIGIN = 1 << 31
#: Doublings of cells that are merged at once: groups have 2^STEP cells at most.
STEP = 6


def _second(c: str | Column) -> Column:
    return F.unix_timestamp((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def _own(values: list[str], flags: list[str]) -> list[Column]:
    """Moments of readings."""
    out = [F.count(F.lit(1)).alias("n")]
    for v in values:
        out += [F.count(v).alias(f"{v}_n"), F.avg(v).alias(f"{v}_mean"), (F.var_pop(v) * F.count(v)).alias(f"{v}_m2"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    return out + [F.count_if(f).alias(f"{f}_n") for f in flags]


def _merged(cells: DataFrame, key: str | list[str], values: list[str], flags: list[str]) -> DataFrame:
    """Cells of a key together; squares are taken about the mean of the key, so that nothing cancels.

    A key has a day's hours, an hour's minutes, or the cells of a range: both steps stand on one shuffle by the key.
    """
    key = [key] if isinstance(key, str) else key
    own = Window.partitionBy(*key)
    mean = {v: F.try_divide(F.sum(F.col(f"{v}_n") * F.col(f"{v}_mean")).over(own), F.sum(f"{v}_n").over(own)) for v in values}
    cells = cells.withColumns({f"__{v}": m for v, m in mean.items()})
    out = [F.sum("n").alias("n")]
    for v in values:
        d = F.col(f"{v}_mean") - F.col(f"__{v}")
        out += [F.sum(f"{v}_n").alias(f"{v}_n"), F.first(f"__{v}").alias(f"{v}_mean"), F.sum(F.col(f"{v}_m2") + F.col(f"{v}_n") * d * d).alias(f"{v}_m2"), F.min(f"{v}_min").alias(f"{v}_min"), F.max(f"{v}_max").alias(f"{v}_max")]
    return cells.groupBy(*key).agg(*out, *(F.sum(f"{f}_n").alias(f"{f}_n") for f in flags))


def cells_of(readings: DataFrame, values: list[str], flags: list[str] = ()) -> dict:
    """Readings with ts -> "cells": (level, start, moments), written, and the names of what they hold."""
    flags = list(flags)
    minute = materialize(readings.filter("ts is not null").groupBy((F.floor(_second("ts") / 60) * 60).alias("start")).agg(*_own(values, flags)), "moments-minute")
    whole, below = minute.withColumn("level", F.lit("minute")), minute
    for level, width in list(LEVELS.items())[1:]:
        below = materialize(_merged(below.withColumn("start", F.floor(F.col("start") / width) * width), "start", values, flags), f"moments-{level}")
        whole = whole.unionByName(below.withColumn("level", F.lit(level)))
    return {"cells": whole, "values": list(values), "flags": flags}


def _pieces(ranges: DataFrame) -> DataFrame:
    """(range_id, start_ts, end_ts) -> (range_id, level, start): the whole cells of each range, the largest that fit.

    ``a`` is the first full minute that begins in the range and ``b`` the end of the last that ends in it.
    """
    late = (F.col("start_ts") > F.timestamp_seconds(_second("start_ts")).cast("timestamp_ntz")).cast("int")  # a fraction of a second
    a = (F.ceil((_second("start_ts") + late) / 60) * 60).cast("long")
    b = (F.floor(_second("end_ts") / 60) * 60).cast("long")
    each = ranges.select("range_id", a.alias("a"), b.alias("b")).filter("a < b")
    step = lambda lo, hi, width: F.when(lo < hi, F.sequence(lo, hi - width, F.lit(width))).otherwise(F.array().cast("array<long>"))
    up = lambda c, w: (F.ceil(c / w) * w).cast("long")
    down = lambda c, w: (F.floor(c / w) * w).cast("long")
    a, b, hour, day = F.col("a"), F.col("b"), F.lit(3600), F.lit(86_400)
    hours, days = up(a, hour) < down(b, hour), up(a, day) < down(b, day)
    minutes = F.when(hours, F.concat(step(a, up(a, hour), 60), step(down(b, hour), b, 60))).otherwise(step(a, b, 60))
    whole_hours = F.when(~hours, F.array().cast("array<long>")).when(days, F.concat(step(up(a, hour), up(a, day), 3600), step(down(b, day), down(b, hour), 3600))).otherwise(step(up(a, hour), down(b, hour), 3600))
    whole_days = F.when(days, step(up(a, day), down(b, day), 86_400)).otherwise(F.array().cast("array<long>"))
    of = lambda level, xs: F.transform(xs, lambda s: F.struct(F.lit(level).alias("level"), s.alias("start")))
    parts = F.concat(of("minute", minutes), of("hour", whole_hours), of("day", whole_days))
    return each.select("range_id", F.explode(parts).alias("p")).select("range_id", "p.*")


def _edges(readings: DataFrame, ranges: DataFrame, made: dict) -> DataFrame:
    """Moments of the readings in the minutes that a range's ends cut."""
    of = lambda c: F.floor(_second(c) / 60) * 60
    edge = ranges.select("range_id", "start_ts", "end_ts", F.explode(F.array_distinct(F.array(of("start_ts"), of("end_ts")))).alias("__minute"))
    # a minute that begins with the range and is over before it ends is a whole cell
    full = (F.timestamp_seconds("__minute").cast("timestamp_ntz") >= F.col("start_ts")) & (F.col("__minute") + 60 <= (F.floor(_second("end_ts") / 60) * 60))
    edge = edge.filter(~full)
    near = readings.withColumn("__minute", of("ts")).join(edge, "__minute").filter(F.col("ts").between(F.col("start_ts"), F.col("end_ts")))
    return near.groupBy("range_id").agg(*_own(made["values"], made["flags"]))


def _minute(c: str) -> Column:
    return (F.floor(_second(c) / 60) + ORIGIN).cast("long")


def _names(made: dict) -> list[str]:
    return ["n", *(f"{v}_{k}" for v in made["values"] for k in ("n", "mean", "m2", "min", "max")), *(f"{f}_n" for f in made["flags"])]


def _asks(good: DataFrame) -> DataFrame:
    """Ranges over more than one minute -> two rows (minute, side, key, level, range_id): side 0 runs back in time from the range's block, 1 forth."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    each = good.select("range_id", _minute("start_ts").alias("a"), _minute("end_ts").alias("b"), us("start_ts").alias("s"), us("end_ts").alias("e")).filter("a < b")
    end = lambda m, side, key: F.struct(F.col(m).alias("minute"), F.lit(side).alias("side"), key.alias("key"))
    level = F.length(F.bin(F.col("a").bitwiseXOR(F.col("b")))) - 1
    return each.select("range_id", level.alias("level"), F.explode(F.array(end("a", 0, -F.col("s")), end("b", 1, F.col("e")))).alias("x")).select("x.*", "level", "range_id")


def _cut(readings: DataFrame, asks: DataFrame, made: dict) -> DataFrame:
    """Asks with the moments of the readings of their minute that lie in the range, running aggregates by time (back for side 0)."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    side = lambda n, key: F.struct(F.lit(n).alias("side"), key.alias("key"))
    at = readings.filter("ts is not null").select(_minute("ts").alias("minute"), F.explode(F.array(side(0, -us), side(1, us))).alias("x"), F.lit(1).alias("one"), *made["values"], *made["flags"])
    both = at.select("minute", "x.*", "one", *made["values"], *made["flags"]).unionByName(asks, allowMissingColumns=True)
    run = Window.partitionBy("minute", "side").orderBy("key")  # to the last of equal times
    out = [F.count("one").over(run).alias("n")]
    for v in made["values"]:
        n = F.count(v).over(run)
        out += [n.alias(f"{v}_n"), F.avg(v).over(run).alias(f"{v}_mean"), (F.var_pop(v).over(run) * n).alias(f"{v}_m2"), F.min(v).over(run).alias(f"{v}_min"), F.max(v).over(run).alias(f"{v}_max")]
    flags = [F.count(F.when(F.col(f), 1)).over(run).alias(f"{f}_n") for f in made["flags"]]
    return both.select("minute", "side", "level", "range_id", *out, *flags).filter("level is not null")


def _blocks(made: dict, levels: int) -> DataFrame:
    """(level, block, moments) of all blocks of 2^level minutes under ``levels``."""
    below = made["cells"].filter("level = 'minute'").select((F.col("start") / 60 + ORIGIN).cast("long").alias("block"), *_names(made)).withColumn("level", F.lit(0))
    out, done = below, 0
    while done < levels - 1:
        more = min(STEP, levels - 1 - done)
        grown = below.withColumn("__up", F.explode(F.array(*map(F.lit, range(1, more + 1))))).withColumns({"level": F.lit(done) + F.col("__up"), "block": F.expr("shiftright(block, __up)")}).drop("__up")
        grown = materialize(_merged(grown, ["level", "block"], made["values"], made["flags"]), "moments-blocks")
        out, below, done = out.unionByName(grown), grown.filter(F.col("level") == done + more), done + more
    return out


def _runs(asks: DataFrame, made: dict) -> DataFrame:
    """(minute, side, runs): by level, the moments of the whole minutes between an end's minute and its block's border.

    These are the blocks of 2^bit minutes beside the minute for the bits under the level that are 0 (1 for side 1): each lies wholly
    between.
    """
    keys = materialize(asks.select("minute", "side", "level").distinct(), "moments-asked")
    levels = keys.agg(F.max("level")).first()[0] or 0
    bit = F.expr("shiftright(minute, bit)")
    beside = keys.filter("level > 0").withColumn("bit", F.explode(F.sequence(F.lit(0), F.col("level") - 1))).filter(bit.bitwiseAND(F.lit(1)) == F.col("side"))
    parts = beside.select("minute", "side", F.col("level").alias("of"), F.col("bit").alias("level"), (bit + F.lit(1) - 2 * F.col("side")).alias("block"))
    whole = parts.join(_blocks(made, levels), ["level", "block"]).drop("level", "block")
    one = _merged(whole, ["minute", "side", "of"], made["values"], made["flags"])
    return one.groupBy("minute", "side").agg(F.map_from_entries(F.collect_list(F.struct("of", F.struct(*_names(made))))).alias("runs"))  # a level once


def _by_runs(readings: DataFrame, good: DataFrame, made: dict) -> DataFrame:
    """range_id and the moments of two rows a range: what it has on either side of the border between its blocks."""
    asks = _asks(good)
    met = _cut(readings, asks, made).join(_runs(asks, made), ["minute", "side"], "left").withColumn("r", F.element_at("runs", F.col("level"))).drop("runs")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = [(F.col("n") + zero(F.col("r.n"))).alias("n")]
    for v in made["values"]:
        n, m, mean, other = F.col(f"{v}_n"), zero(F.col(f"r.{v}_n")), F.col(f"{v}_mean"), F.col(f"r.{v}_mean")
        d = F.when((n > 0) & (m > 0), other - mean).otherwise(0.0)
        joined = F.coalesce(mean, other) + d * F.when(n > 0, m / (n + m)).otherwise(0.0)
        m2 = F.when(n + m > 0, zero(F.col(f"{v}_m2")) + zero(F.col(f"r.{v}_m2")) + d * d * n * m / F.greatest(n + m, F.lit(1)))
        out += [(n + m).alias(f"{v}_n"), joined.alias(f"{v}_mean"), m2.alias(f"{v}_m2"), F.least(f"{v}_min", f"r.{v}_min").alias(f"{v}_min"), F.greatest(f"{v}_max", f"r.{v}_max").alias(f"{v}_max")]
    sides = met.select("range_id", *out, *((F.col(f"{f}_n") + zero(F.col(f"r.{f}_n"))).alias(f"{f}_n") for f in made["flags"])).filter("n > 0")
    return _merged(sides.unionByName(_short(readings, good, made)), "range_id", made["values"], made["flags"])


def _short(readings: DataFrame, good: DataFrame, made: dict) -> DataFrame:
    """Moments of the ranges within one minute, which meet the readings by second."""
    some = good.filter(_minute("start_ts") == _minute("end_ts")).withColumn("__second", F.explode(F.sequence(_second("start_ts"), _second("end_ts"))))
    near = readings.withColumn("__second", _second("ts")).join(some, "__second").filter(F.col("ts").between(F.col("start_ts"), F.col("end_ts")))
    return near.groupBy("range_id").agg(*_own(made["values"], made["flags"]))


def range_moments(readings: DataFrame, ranges: DataFrame, made: dict, few: int = FEW) -> DataFrame:
    """Parsed ranges (range_id, start_ts, end_ts) -> range_id and the moments of its readings; ranges without readings have no row."""
    good = ranges.filter("start_ts <= end_ts").select("range_id", "start_ts", "end_ts")
    if good.limit(few + 1).count() > few:
        return _by_runs(readings, good, made)
    inner = _pieces(good).join(made["cells"], ["level", "start"]).drop("level", "start")
    both = inner.unionByName(_edges(readings, good, made))
    return _merged(both, "range_id", made["values"], made["flags"])


def stats_by_cells(readings: DataFrame, ranges: DataFrame, made: dict | None = None, few: int = FEW) -> DataFrame:
    """``stats_by_range`` from cells: count, mean, max, min and sample deviation of target for each row of a range table."""
    made = made or cells_of(readings, ["target"])
    parsed = parse_ranges(ranges)
    out = parsed.join(range_moments(readings, parsed, made, few), "range_id", "left")
    std = F.when(F.col("target_n") > 1, F.sqrt(F.try_divide(F.col("target_m2"), F.col("target_n") - 1)))
    return out.select("range_id", F.when(F.col("valid"), "ok").otherwise("invalid_time").alias("status"), F.when(F.col("valid"), F.coalesce("n", F.lit(0))).alias("count"), "target_mean", "target_max", "target_min", std.alias("target_std"))


def monitor_by_cells(scored: DataFrame, ranges: DataFrame, made: dict | None = None, few: int = FEW) -> DataFrame:
    """Scored readings: for each range the statistics of t2 and spe (population deviation) and the numbers of flags."""
    made = made or cells_of(scored, ["t2", "spe"], ["t2_anomaly", "spe_anomaly", "anomaly"])
    parsed = parse_ranges(ranges)
    out = parsed.join(range_moments(scored, parsed, made, few), "range_id", "left")
    stat = lambda v: [F.col(f"{v}_mean"), F.col(f"{v}_max"), F.col(f"{v}_min"), F.sqrt(F.try_divide(F.col(f"{v}_m2"), F.col(f"{v}_n"))).alias(f"{v}_std")]
    counts = [F.when(F.col("valid"), F.coalesce(c, F.lit(0))).alias(name) for c, name in (("n", "total"), ("anomaly_n", "anomalies"), ("t2_anomaly_n", "t2_anomalies"), ("spe_anomaly_n", "spe_anomalies"))]
    return out.select("range_id", "valid", *counts, *stat("t2"), *stat("spe"))
