"""Text report of analysed ranges, one string a row, and rows as JSON for callers outside Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of the report.
RULE = "=" * 70
TITLE, FAILED = "📊 束流波动分析报告", "❌ 分析失败："


def _stat(name: str, c: str, limit: str) -> Column:
    four = lambda label, col: F.format_string(f"    - {label}：%.4f", F.col(col))
    return F.concat_ws("\n", F.lit(f"  {name}统计量："), four("均值", f"{c}_mean"), four("最大值", f"{c}_max"), four("最小值", f"{c}_min"), four("标准差", f"{c}_std"), four("控制上限 (UCL)", limit))


def _ranked(name: str, c: str) -> Column:
    lines = F.transform(F.col(c), lambda x, i: F.format_string("    %d. %s: %.6f", i + 1, x["feature"], x["value"]))
    return F.when(F.col(c).isNotNull(), F.concat_ws("\n", F.lit(f"\n  {name}异常主要贡献特征："), F.array_join(lines, "\n")))


def text_report(analysed: DataFrame) -> DataFrame:
    """Rows of analyze_ranges -> range_id, report."""
    rate = F.format_string("%.2f%%", F.col("anomaly_count") * 100.0 / F.col("total_samples"))
    put = lambda text, *c: F.format_string(text, *(F.col(x) if isinstance(x, str) else x for x in c))
    emoji = F.when(F.col("has_anomaly"), "⚠️").otherwise("✅")
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    first = F.concat_ws("\n", F.lit("\n【首个异常点详情】"), F.concat(F.lit("  时间："), when("first_anomaly.ts")), put("  位置：第 %d 个数据点", F.col("first_anomaly.position") + 1), put("  T²值：%.4f (阈值: %.4f)", "first_anomaly.t2", "ucl_t2"), put("  SPE值：%.4f (阈值: %.4f)", "first_anomaly.spe", "ucl_spe"), _ranked("T²", "first_anomaly.t2_top"), _ranked("SPE", "first_anomaly.spe_top"))
    calm = F.lit("  ✓ 该时间段内束流运行状况良好，所有数据点均在正常范围内。\n  ✓ T²统计量和SPE统计量均未超出控制上限。\n  ✓ 未检测到显著的异常波动。")
    alarm = F.concat_ws("\n", put("  ⚠ 该时间段内检测到 %d 个异常点。", "anomaly_count"), F.concat(F.lit("  ⚠ 异常率为 "), rate, F.lit("，需要关注。")), first)
    body = F.concat_ws(
        "\n", F.lit(RULE), F.lit(TITLE), F.lit(RULE),
        F.lit("\n【分析时间范围】"), put("  起始时间：%s", "start_time"), put("  结束时间：%s", "end_time"), put("  数据条数：%d 条", "total_samples"),
        F.lit("\n【统计指标】"), _stat("T²", "t2", "ucl_t2"), F.concat(F.lit("\n"), _stat("SPE", "spe", "ucl_spe")),
        F.lit("\n【异常检测结果】"), F.concat(F.lit("  状态："), emoji, F.lit(" "), F.col("status_word")), put("  总样本数：%d 个", "total_samples"), put("  异常点数：%d 个", "anomaly_count"), F.concat(F.lit("  异常率："), rate), put("  T²异常数：%d 个", "t2_count"), put("  SPE异常数：%d 个", "spe_count"),
        F.lit("\n【分析结论】"), F.when(F.col("has_anomaly"), alarm).otherwise(calm), F.lit("\n" + RULE),
    )
    return analysed.select("range_id", F.when(F.col("status") == "ok", body).otherwise(F.concat(F.lit(FAILED), F.col("status"))).alias("report"))


def envelope(rows: DataFrame, key: str, status: str | None = None) -> DataFrame:
    """(key, json): a row as {success, data}, or {success, error} where its status is not ok."""
    good = F.lit(True) if status is None else F.coalesce(F.col(status) == "ok", F.lit(False))
    data = F.struct(*(F.col(c) for c in rows.columns))
    none = F.lit(None)
    error = F.when(~good, F.col(status)) if status else none.cast("string")
    return rows.select(key, F.to_json(F.struct(good.alias("success"), F.when(good, data).alias("data"), error.alias("error"))).alias("json"))
