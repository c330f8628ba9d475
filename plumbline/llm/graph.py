"""Connected components by alternating large and small stars (Kiveris et al. 2014), on tables in the shared folder.

Every half round aggregates the least neighbour of each node (combined before the shuffle) and joins it back. Both sides of
that join are read from written tables, so adaptive execution can split the rows of a hub among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize


def _least(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy("a").agg(F.min("b").alias("m")), "star-least").withColumnRenamed("a", "__a")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    out = both.join(_least(both), F.col("a") == F.col("__a")).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return materialize(out.distinct(), "star-large")


def _small(edges: DataFrame) -> DataFrame:
    each = edges.join(_least(edges), F.col("a") == F.col("__a")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return materialize(each.select("e.a", "e.b").filter("a > b").distinct(), "star-small")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.hash("b", "a").cast("long"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Links (a, b) of long ids -> (node, component), component being the least id reachable; nodes without a link are absent.

    Self-links, repeated links and either direction are allowed; links with a null end are left out. Rounds grow
    with the square of the logarithm of the number of nodes at worst; more than ``rounds`` of them is an error.
    """
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(ordered, "star-links")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        now = _small(_large(now))
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
