"""Scoring of readings against a latent-variable model: T2 and SPE, flags, contributions, and their summaries by range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.model import Model
from plumbline.operators.readings import feature_columns, parse_ranges, range_join
from plumbline.sources.shared import materialize

#: Products of features and components up to which scores are column expressions; beyond, they are taken a batch at a time, with
#: the same additions in the same order, so that no bit differs.
UNROLL = 200
NORMAL, ABNORMAL, CLEAR = "正常", "异常", "未检测到异常，数据波动在正常范围内"


def validate_features(df: DataFrame, model: Model) -> list[str]:
    """The feature columns, if they are as many as the model's; an error otherwise."""
    cols = feature_columns(df)
    if not cols:
        raise ValueError("no feature columns")
    if len(cols) != len(model.names):
        raise ValueError(f"{len(cols)} feature columns, but the model has {len(model.names)}")
    return cols


def standardize(cols: list[str], m: Model) -> list[Column]:
    return [(F.col(c) - F.lit(mu)) / F.lit(s) for c, mu, s in zip(cols, m.x_mean, m.x_scale, strict=True)]


def _total(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def pls_scores(z: list[Column], m: Model) -> list[Column]:
    """Components of standardised features, which the model centres and scales once more."""
    u = [(c - F.lit(mu)) / F.lit(s) for c, mu, s in zip(z, m.pls_mean, m.pls_std, strict=True)]
    return [_total([u[j] * F.lit(m.rotations[j][a]) for j in range(len(u))]) for a in range(len(m.eigenvalues))]


def t2_statistic(t: list[Column], m: Model) -> Column:
    return _total([x * x / F.lit(v) for x, v in zip(t, m.eigenvalues, strict=True)])


def residuals(z: list[Column], t: list[Column], m: Model) -> list[Column]:
    return [z[j] - _total([t[a] * F.lit(m.loadings[j][a]) for a in range(len(t))]) for j in range(len(z))]


def spe_statistic(e: Column) -> Column:
    return F.aggregate(F.transform(e, lambda x: x * x), F.lit(0.0), lambda a, x: a + x)


def in_order(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, added from left to right as the column expressions add."""
    out = x[:, :1] * w[0]
    for j in range(1, len(w)):
        out = out + x[:, j : j + 1] * w[j]
    return out


def _matrix_scores(m: Model):
    mean, scale, pm, ps, r, p, lam = (np.array(x) for x in (m.x_mean, m.x_scale, m.pls_mean, m.pls_std, m.rotations, m.loadings, m.eigenvalues))

    @F.pandas_udf("t array<double>, e array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            z = (np.stack([np.asarray(v, dtype=float) for v in x]) - mean) / scale if len(x) else np.zeros((0, len(mean)))
            t = in_order((z - pm) / ps, r)
            yield pd.DataFrame({"t": list(t), "e": list(z - in_order(t, p.T))})

    return score


def score(readings: DataFrame, m: Model, null_policy: str = "drop") -> DataFrame:
    """Readings with t (components), e (residuals), t2, spe and the three flags. Rows with a null feature go, or raise."""
    cols = validate_features(readings, m)
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    if null_policy == "error":
        df = readings.filter(F.when(whole, True).otherwise(F.raise_error(F.lit("null feature")).cast("boolean")))
    else:
        df = readings.filter(whole)
    if len(cols) * len(m.eigenvalues) <= UNROLL:
        names_z, names_t = [f"__z{j}" for j in range(len(cols))], [f"__t{a}" for a in range(len(m.eigenvalues))]
        df = df.withColumns(dict(zip(names_z, standardize(cols, m), strict=True)))
        df = df.withColumns(dict(zip(names_t, pls_scores([F.col(c) for c in names_z], m), strict=True)))
        df = df.withColumns({"t": F.array(*names_t), "e": F.array(*residuals([F.col(c) for c in names_z], [F.col(c) for c in names_t], m))}).drop(*names_z, *names_t)
    else:
        df = df.withColumn("__s", _matrix_scores(m)(F.array(*cols))).withColumns({"t": F.col("__s.t"), "e": F.col("__s.e")}).drop("__s")
    df = df.withColumns({"t2": t2_statistic([F.col("t")[a] for a in range(len(m.eigenvalues))], m), "spe": spe_statistic(F.col("e"))})
    return flag_anomalies(df, m)


def flag_anomalies(df: DataFrame, m: Model) -> DataFrame:
    """Strictly above the limit; either flag makes an anomaly."""
    df = df.withColumns({"t2_anomaly": F.col("t2") > F.lit(m.ucl_t2), "spe_anomaly": F.col("spe") > F.lit(m.ucl_spe)})
    return df.withColumn("anomaly", F.col("t2_anomaly") | F.col("spe_anomaly"))


def t2_contributions(m: Model) -> Column:
    """Array by feature: sum over components of (t_a p_ja)^2 / lambda_a."""
    return F.array(*(_total([(F.col("t")[a] * F.lit(row[a])) * (F.col("t")[a] * F.lit(row[a])) / F.lit(v) for a, v in enumerate(m.eigenvalues)]) for row in m.loadings))


def spe_contributions() -> Column:
    return F.transform("e", lambda e: e * e)


def top_features(contributions: Column, m: Model, n: int = 3) -> Column:
    """The n largest as array<struct<feature, value>>, ties by feature position."""
    named = F.zip_with(contributions, F.array(*(F.struct(F.lit(-i).alias("i"), F.lit(x).alias("f")) for i, x in enumerate(m.names))), lambda v, f: F.struct(v.alias("value"), f["i"].alias("i"), f["f"].alias("feature")))
    return F.transform(F.slice(F.reverse(F.array_sort(named)), 1, n), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value")))


def explain(scored: DataFrame, m: Model) -> DataFrame:
    """Anomalous rows with the top features of each statistic that is over its limit."""
    top = lambda flag, c: F.when(F.col(flag), top_features(c, m))
    return scored.filter("anomaly").withColumns({"t2_top": top("t2_anomaly", t2_contributions(m)), "spe_top": top("spe_anomaly", spe_contributions())})


def monitor_stats() -> list[Column]:
    """Mean, max, min and population deviation of both statistics."""
    return [f(c).alias(f"{c}_{k}") for c in ("t2", "spe") for k, f in (("mean", F.avg), ("max", F.max), ("min", F.min), ("std", F.stddev_pop))]


def anomaly_counts() -> list[Column]:
    n = F.count(F.lit(1))
    hits = F.count_if("anomaly")
    return [n.alias("total_samples"), hits.alias("anomaly_count"), F.count_if("t2_anomaly").alias("t2_count"), F.count_if("spe_anomaly").alias("spe_count"), F.when(n > 0, F.round(hits / n, 4)).otherwise(0.0).alias("anomaly_rate")]


def first_anomaly(scored: DataFrame, m: Model, by: str = "range_id") -> DataFrame:
    """Earliest anomalous reading of each group, by (ts, reading_id), with its 0-based position and top features.

    The position is the number of readings before it: a count after a join with one row a group, no sort.
    """
    first = scored.filter("anomaly").groupBy(by).agg(F.min_by(F.struct("ts", "reading_id", "t", "e", "t2", "spe", "t2_anomaly", "spe_anomaly", "anomaly"), F.struct("ts", "reading_id")).alias("f")).select(by, "f.*")
    found = explain(first, m).drop("t", "e")
    key = found.select(by, F.col("ts").alias("__ts"), F.col("reading_id").alias("__id"))
    before = scored.join(key, by).groupBy(by).agg(F.count_if(F.struct("ts", "reading_id") < F.struct(F.col("__ts"), F.col("__id"))).alias("position"))
    return found.join(before, by)


def analysis_summary() -> list[Column]:
    """has_anomaly, status word and message, over anomaly_count and total_samples."""
    n, rate = F.col("anomaly_count"), F.format_string("%.2f%%", F.col("anomaly_count") * 100.0 / F.col("total_samples"))
    message = F.concat(F.lit("检测到 "), n.cast("string"), F.lit(" 个异常点（异常率: "), rate, F.lit("）"))
    return [(n > 0).alias("has_anomaly"), F.when(n > 0, ABNORMAL).otherwise(NORMAL).alias("status_word"), F.when(n > 0, message).otherwise(CLEAR).alias("message")]


def control_chart_series(scored: DataFrame, m: Model) -> DataFrame:
    return scored.select("reading_id", "ts", "t2", F.lit(m.ucl_t2).alias("ucl_t2"), "spe", F.lit(m.ucl_spe).alias("ucl_spe"), "t2_anomaly", "spe_anomaly", "anomaly")


def analyze_ranges(readings: DataFrame, ranges: DataFrame, m: Model) -> DataFrame:
    """One row a range: status, statistics, counts, limits, first anomaly and summary.

    Readings are scored once, before ranges that overlap repeat them, and written: statistics, first anomalies and positions
    read what was scored.
    """
    parsed = parse_ranges(ranges)
    columns = ["ts", "reading_id", "t", "e", "t2", "spe", "t2_anomaly", "spe_anomaly", "anomaly"]
    scored = materialize(range_join(score(readings, m).select(*columns), parsed), "scored-ranges")
    agg = scored.groupBy("range_id").agg(*monitor_stats(), *anomaly_counts())
    first = first_anomaly(scored, m)
    struct = F.struct("position", "ts", "reading_id", "t2", "spe", "t2_anomaly", "spe_anomaly", "t2_top", "spe_top").alias("first_anomaly")
    out = parsed.join(agg, "range_id", "left").join(first.select("range_id", struct), "range_id", "left")
    status = F.when(~F.col("valid"), "invalid_time").when(F.col("total_samples").isNull(), "no_data").otherwise("ok")
    return out.select("range_id", "start_time", "end_time", status.alias("status"), *(c for c in agg.columns if c != "range_id"), F.lit(m.ucl_t2).alias("ucl_t2"), F.lit(m.ucl_spe).alias("ucl_spe"), "first_anomaly", *analysis_summary())
