"""One registered query an operator, with its SQL twin where SQL can say it. Doubles are rounded, arrays joined."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import chunks as ch
from plumbline.operators import knowledge as kn
from plumbline.operators import moments as mm
from plumbline.operators import monitor as mo
from plumbline.operators import readings as rd
from plumbline.operators import search as se
from plumbline.operators import tfidf as tf
from plumbline.plans import fixtures as fx
from plumbline.plans.fit import fit_model
from plumbline.plans.report import envelope, text_report
from plumbline.sources.files import append_index, read_index, write_index
from plumbline.sources.readings import TIME, read_days, read_readings, write_readings
from plumbline.sources.shared import materialize, shared_dir
from plumbline.streaming.monitor import monitor_stream
from plumbline.streaming.ranges import replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
M = fx.MODEL


def query(name: str, sql: str | None = None, ctes: str = ""):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (f"WITH {ctes} " if ctes else "") + sql
        return f

    return add


def r6(*names: str, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n.rpartition(".")[2]) for n in names]


def r6s(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def scored(s: SparkSession, d: str) -> DataFrame:
    return mo.score(fx.readings(s, d), M)


# Readings

_day = f"ts BETWEEN TIMESTAMP '{fx.DAY[0]}' AND TIMESTAMP '{fx.DAY[1].replace('T', ' ')}'"
query("time_range_filter", f"SELECT * FROM readings WHERE {_day}", fx.READINGS)(lambda s, d: rd.time_range_filter(fx.readings(s, d), *fx.DAY))


@query("read_readings", "SELECT row_number() OVER (ORDER BY ts, reading_id) - 1 AS reading_id, ts, target, feature1, feature2, feature3, feature4, feature5, reading_id::VARCHAR AS event FROM readings", fx.READINGS)
def _(s: SparkSession, d: str) -> DataFrame:
    """All readings as CSV files in order of time, as a logger leaves them, and back."""
    path, rows = f"{shared_dir(s)}/logged-{uuid.uuid4().hex}", fx.readings(s, d)
    features = [c for c in rows.columns if c.startswith("feature")]
    logged = rows.repartitionByRange(4, "ts", "reading_id").sortWithinPartitions("ts", "reading_id").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(TIME), "target", *features, F.col("reading_id").cast("string").alias("event"))
    logged.write.option("header", True).csv(path)
    return read_readings(s, path)


@query("read_days", f"SELECT * FROM readings WHERE {_day}", fx.READINGS)
def _days(s, d):
    path = f"{shared_dir(s)}/readings-{uuid.uuid4().hex}"
    write_readings(fx.readings(s, d), path)
    return read_days(s, path, *fx.DAY)


query("project_columns", "SELECT target, ts FROM readings", fx.READINGS)(lambda s, d: rd.project_columns(fx.readings(s, d), ["target", "nothing", "ts"]))
query("format_time", "SELECT reading_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM readings", fx.READINGS)(lambda s, d: rd.format_time(fx.readings(s, d)).select("reading_id", "ts"))
query("recent_range", "SELECT reading_id, ts, target FROM readings WHERE ts BETWEEN (SELECT max(ts) FROM readings) - INTERVAL 7 DAY AND (SELECT max(ts) FROM readings)", fx.READINGS)(lambda s, d: rd.recent_range(fx.readings(s, d), "7 days").select("reading_id", "ts", "target"))
_stats = "round(avg(target), 6) AS target_mean, max(target) AS target_max, min(target) AS target_min, round(stddev_samp(target), 6) AS target_std"
query("range_stats", f"SELECT count(*) AS count, {_stats} FROM readings WHERE {_day}", fx.READINGS)(lambda s, d: rd.range_stats(rd.time_range_filter(fx.readings(s, d), *fx.DAY)).select("count", *r6("target_mean"), "target_max", "target_min", *r6("target_std")))
query("range_preview", f"SELECT reading_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, target FROM readings WHERE {_day} ORDER BY readings.ts, reading_id LIMIT 5", fx.READINGS)(lambda s, d: rd.preview(rd.time_range_filter(fx.readings(s, d), *fx.DAY)).select("reading_id", "ts", "target"))
query("dataset_summary", f"SELECT count(*) AS total_rows, 'reading_id,ts,target,feature1,feature2,feature3,feature4,feature5' AS columns, min(ts) AS min_time, max(ts) AS max_time, {_stats} FROM readings", fx.READINGS)(lambda s, d: rd.dataset_summary(fx.readings(s, d)).select("total_rows", "columns", "min_time", "max_time", *r6("target_mean"), "target_max", "target_min", *r6("target_std")))
query("range_join", "SELECT range_id, reading_id, ts FROM ranges JOIN readings ON ts BETWEEN start_ts AND end_ts", f"{fx.READINGS}, {fx.RANGES_SQL}")(lambda s, d: rd.range_join(fx.readings(s, d), rd.parse_ranges(fx.ranges(s))).select("range_id", "reading_id", "ts"))
query("range_join_buckets", "SELECT range_id, reading_id, ts FROM ranges JOIN readings ON ts BETWEEN start_ts AND end_ts", f"{fx.READINGS}, {fx.RANGES_SQL}")(lambda s, d: rd.range_join(fx.readings(s, d), rd.parse_ranges(fx.ranges(s)), broadcast_ranges=0).select("range_id", "reading_id", "ts"))
query("stats_by_range", f"SELECT range_id, CASE WHEN valid THEN 'ok' ELSE 'invalid_time' END AS status, CASE WHEN valid THEN count(reading_id) END AS count, {_stats} FROM ranges LEFT JOIN readings ON ts BETWEEN start_ts AND end_ts GROUP BY range_id, valid", f"{fx.READINGS}, {fx.RANGES_SQL}")(lambda s, d: rd.stats_by_range(fx.readings(s, d), fx.ranges(s)).select("range_id", "status", "count", *r6("target_mean"), "target_max", "target_min", *r6("target_std")))

# Monitoring

query("standardize", "SELECT reading_id, " + ", ".join(f"round(z{j}, 6) AS z{j}" for j in range(5)) + " FROM z", fx.SCORED)(lambda s, d: fx.readings(s, d).select("reading_id", *(F.round(c, 6).alias(f"z{j}") for j, c in enumerate(mo.standardize([f"feature{i}" for i in range(1, 6)], M)))))
query("pls_scores", f"SELECT reading_id, {r6s('t0', 't1')} FROM scored", fx.SCORED)(lambda s, d: scored(s, d).select("reading_id", *(F.round(F.col("t")[a], 6).alias(f"t{a}") for a in range(2))))
query("score", f"SELECT reading_id, {r6s('t2', 'spe')} FROM scored", fx.SCORED)(lambda s, d: scored(s, d).select("reading_id", *r6("t2", "spe")))
query("flag_anomalies", "SELECT reading_id, t2_anomaly, spe_anomaly, anomaly FROM scored", fx.SCORED)(lambda s, d: scored(s, d).select("reading_id", "t2_anomaly", "spe_anomaly", "anomaly"))
query("t2_contributions", "SELECT reading_id, " + ", ".join(f"round(c{j}, 6) AS c{j}" for j in range(5)) + " FROM scored WHERE t2_anomaly", fx.SCORED)(lambda s, d: scored(s, d).filter("t2_anomaly").withColumn("c", mo.t2_contributions(M)).select("reading_id", *(F.round(F.col("c")[j], 6).alias(f"c{j}") for j in range(5))))
query("spe_contributions", "SELECT reading_id, " + ", ".join(f"round(e{j} * e{j}, 6) AS c{j}" for j in range(5)) + " FROM scored WHERE spe_anomaly", fx.SCORED)(lambda s, d: scored(s, d).filter("spe_anomaly").withColumn("c", mo.spe_contributions()).select("reading_id", *(F.round(F.col("c")[j], 6).alias(f"c{j}") for j in range(5))))
_long = "top AS (SELECT reading_id, stat, feature, value, row_number() OVER (PARTITION BY reading_id, stat ORDER BY value DESC, j) AS rank FROM (" + " UNION ALL ".join(f"SELECT reading_id, '{k}' AS stat, 'feature{j + 1}' AS feature, {j} AS j, {v} AS value FROM scored WHERE {k}_anomaly" for j in range(5) for k, v in (("t2", f"c{j}"), ("spe", f"e{j} * e{j}"))) + ") QUALIFY rank <= 3)"


@query("top_features", "SELECT reading_id, stat, rank, feature, round(value, 6) AS value FROM top", f"{fx.SCORED}, {_long}")
def _top(s, d):
    x = mo.explain(scored(s, d), M)
    one = lambda k: x.select("reading_id", F.lit(k).alias("stat"), F.posexplode(f"{k}_top").alias("p", "f")).select("reading_id", "stat", (F.col("p") + 1).cast("long").alias("rank"), "f.feature", F.round("f.value", 6).alias("value"))
    return one("t2").union(one("spe"))


query("control_chart_series", f"SELECT reading_id, ts, round(t2, 6) AS t2, {M.ucl_t2}::DOUBLE AS ucl_t2, round(spe, 6) AS spe, {M.ucl_spe}::DOUBLE AS ucl_spe, anomaly FROM scored WHERE {_day}", fx.SCORED)(lambda s, d: mo.control_chart_series(rd.time_range_filter(scored(s, d), *fx.DAY), M).select("reading_id", "ts", *r6("t2"), "ucl_t2", *r6("spe"), "ucl_spe", "anomaly"))
_mon = ", ".join(f"round({f}({c}), 6) AS {c}_{k}" for c in ("t2", "spe") for k, f in (("mean", "avg"), ("max", "max"), ("min", "min"), ("std", "stddev_pop")))
_MON = [f"{c}_{k}" for c in ("t2", "spe") for k in ("mean", "max", "min", "std")]
_cnt = "count(*) AS total_samples, count(*) FILTER (WHERE anomaly) AS anomaly_count, count(*) FILTER (WHERE t2_anomaly) AS t2_count, count(*) FILTER (WHERE spe_anomaly) AS spe_count, round(count(*) FILTER (WHERE anomaly) / count(*), 4) AS anomaly_rate"
_CNT = ["total_samples", "anomaly_count", "t2_count", "spe_count", "anomaly_rate"]
query("monitor_stats", f"SELECT {_mon} FROM scored", fx.SCORED)(lambda s, d: scored(s, d).agg(*mo.monitor_stats()).select(*r6(*_MON)))
query("anomaly_counts", f"SELECT {_cnt} FROM scored", fx.SCORED)(lambda s, d: scored(s, d).agg(*mo.anomaly_counts()))
_inr = f"{fx.SCORED}, {fx.RANGES_SQL}, inr AS (SELECT range_id, s.* FROM ranges JOIN scored s ON ts BETWEEN start_ts AND end_ts), pos AS (SELECT *, row_number() OVER (PARTITION BY range_id ORDER BY ts, reading_id) - 1 AS position FROM inr), firsts AS (SELECT * FROM pos WHERE anomaly QUALIFY row_number() OVER (PARTITION BY range_id ORDER BY position) = 1)"
query("first_anomaly", "SELECT range_id, reading_id, ts, position, round(t2, 6) AS t2, round(spe, 6) AS spe, t2_anomaly, spe_anomaly FROM firsts", _inr)(lambda s, d: mo.first_anomaly(rd.range_join(scored(s, d), rd.parse_ranges(fx.ranges(s))), M).select("range_id", "reading_id", "ts", "position", *r6("t2", "spe"), "t2_anomaly", "spe_anomaly"))
_status = "CASE WHEN NOT valid THEN 'invalid_time' WHEN total_samples IS NULL THEN 'no_data' ELSE 'ok' END AS status"
_agg = f"agg AS (SELECT range_id, {_mon}, {_cnt} FROM inr GROUP BY range_id)"


def analysed(s: SparkSession, d: str) -> DataFrame:
    return mo.analyze_ranges(fx.readings(s, d), fx.ranges(s), M)


query("analyze_ranges", f"SELECT r.range_id, {_status}, {', '.join(_MON + _CNT)}, f.position, f.reading_id AS first_id FROM ranges r LEFT JOIN agg USING (range_id) LEFT JOIN firsts f USING (range_id)", f"{_inr}, {_agg}")(lambda s, d: analysed(s, d).select("range_id", "status", *r6(*_MON), *_CNT, F.col("first_anomaly.position").alias("position"), F.col("first_anomaly.reading_id").alias("first_id")))
query("analysis_summary", "SELECT r.range_id, anomaly_count > 0 AS has_anomaly, CASE WHEN anomaly_count > 0 THEN '异常' ELSE '正常' END AS status_word, CASE WHEN anomaly_count > 0 THEN '检测到 ' || anomaly_count || ' 个异常点（异常率: ' || printf('%.2f%%', anomaly_count * 100.0 / total_samples) || '）' ELSE '未检测到异常，数据波动在正常范围内' END AS message FROM ranges r LEFT JOIN agg USING (range_id)", f"{_inr}, {_agg}")(lambda s, d: analysed(s, d).select("range_id", "has_anomaly", "status_word", "message"))
_four = "printf('%.4f', {0})".format
_block = lambda name, c, ucl: " || chr(10) || ".join([f"'  {name}统计量：'", *(f"'    - {label}：' || {_four(x)}" for label, x in (("均值", f"avg_{c}"), ("最大值", f"max_{c}"), ("最小值", f"min_{c}"), ("标准差", f"std_{c}"), ("控制上限 (UCL)", f"{ucl}::DOUBLE")))])
_contrib = lambda name, stat: f"CASE WHEN f.{stat}_anomaly THEN chr(10) || chr(10) || '  {name}异常主要贡献特征：' || chr(10) || (SELECT string_agg('    ' || rank || '. ' || feature || ': ' || printf('%.6f', value), chr(10) ORDER BY rank) FROM top WHERE top.reading_id = f.reading_id AND stat = '{stat}') ELSE '' END"
_raw = "raw AS (SELECT range_id, " + ", ".join(f"{f}({c}) AS {k}_{c}" for c in ("t2", "spe") for k, f in (("avg", "avg"), ("max", "max"), ("min", "min"), ("std", "stddev_pop"))) + ", count(*) AS n, count(*) FILTER (WHERE anomaly) AS hit, count(*) FILTER (WHERE t2_anomaly) AS t2n, count(*) FILTER (WHERE spe_anomaly) AS spen FROM inr GROUP BY range_id)"
_rate = "printf('%.2f%%', hit * 100.0::DOUBLE / n)"
_rule = "'" + "=" * 70 + "'"
_alarm = " || ".join(["'  ⚠ 该时间段内检测到 ' || hit || ' 个异常点。' || chr(10) || '  ⚠ 异常率为 '", _rate, "'，需要关注。' || chr(10) || chr(10) || '【首个异常点详情】' || chr(10) || '  时间：' || strftime(f.ts, '%Y-%m-%d %H:%M:%S') || chr(10) || '  位置：第 ' || (f.position + 1) || ' 个数据点' || chr(10) || '  T²值：'", _four("f.t2"), f"' (阈值: ' || {_four(f'{M.ucl_t2}::DOUBLE')} || ')' || chr(10) || '  SPE值：'", _four("f.spe"), f"' (阈值: ' || {_four(f'{M.ucl_spe}::DOUBLE')} || ')'", _contrib("T²", "t2"), _contrib("SPE", "spe")])
_calm = "'  ✓ 该时间段内束流运行状况良好，所有数据点均在正常范围内。' || chr(10) || '  ✓ T²统计量和SPE统计量均未超出控制上限。' || chr(10) || '  ✓ 未检测到显著的异常波动。'"
_body = " || chr(10) || ".join([_rule, "'📊 束流波动分析报告'", _rule, "chr(10) || '【分析时间范围】'", "'  起始时间：' || r.start_time", "'  结束时间：' || r.end_time", "'  数据条数：' || n || ' 条'", "chr(10) || '【统计指标】'", _block("T²", "t2", M.ucl_t2), "chr(10) || " + _block("SPE", "spe", M.ucl_spe), "chr(10) || '【异常检测结果】'", "'  状态：' || CASE WHEN hit > 0 THEN '⚠️ 异常' ELSE '✅ 正常' END", "'  总样本数：' || n || ' 个'", "'  异常点数：' || hit || ' 个'", "'  异常率：' || " + _rate, "'  T²异常数：' || t2n || ' 个'", "'  SPE异常数：' || spen || ' 个'", "chr(10) || '【分析结论】'", f"CASE WHEN hit > 0 THEN {_alarm} ELSE {_calm} END", "chr(10) || " + _rule])
query("text_report", f"SELECT r.range_id, CASE WHEN NOT valid THEN '❌ 分析失败：invalid_time' WHEN n IS NULL THEN '❌ 分析失败：no_data' ELSE {_body} END AS report FROM ranges r LEFT JOIN raw USING (range_id) LEFT JOIN firsts f USING (range_id)", f"{_inr}, {_raw}, {_long}")(lambda s, d: text_report(analysed(s, d)))
query("envelope", "SELECT range_id, CASE WHEN valid THEN '{\"success\":true,\"data\":{\"range_id\":' || range_id || ',\"status\":\"ok\",\"count\":' || count(reading_id) || '}}' ELSE '{\"success\":false,\"error\":\"invalid_time\"}' END AS json FROM ranges LEFT JOIN readings ON ts BETWEEN start_ts AND end_ts GROUP BY range_id, valid", f"{fx.READINGS}, {fx.RANGES_SQL}")(lambda s, d: envelope(rd.stats_by_range(fx.readings(s, d), fx.ranges(s)).select("range_id", "status", "count"), "range_id", "status"))


def _pls_sql(components: int = 4) -> str:
    """CTEs: partial least squares of the wide readings, a component at a time, and their scores."""
    out = [
        "long AS (SELECT vec_id AS k, unnest(range(1, 65)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)",
        "x AS MATERIALIZED (SELECT k, j, (v - m) / s AS z FROM long JOIN (SELECT j, avg(v) AS m, stddev_pop(v) AS s FROM long GROUP BY j) USING (j))",
        "y AS (SELECT vec_id AS k, (label - avg(label) OVER ()) / stddev_pop(label) OVER () AS z FROM embeddings)",
        "c0 AS MATERIALIZED (SELECT j, avg(x.z * y.z) AS v FROM x JOIN y USING (k) GROUP BY j)",
    ]
    for a in range(1, components + 1):
        known = "".join(f" - (SELECT sum(q.v * u.v) FROM p{b} q JOIN w{a} u USING (j)) * r{b}.v" for b in range(1, a))
        joins = "".join(f" JOIN r{b} USING (j)" for b in range(1, a))
        out += [
            f"w{a} AS MATERIALIZED (SELECT j, v / sqrt((SELECT sum(v * v) FROM c{a - 1})) AS v FROM c{a - 1})",
            f"r{a} AS MATERIALIZED (SELECT j, w{a}.v{known} AS v FROM w{a}{joins})",
            f"t{a} AS MATERIALIZED (SELECT k, sum(x.z * r{a}.v) AS t FROM x JOIN r{a} USING (j) GROUP BY k)",
            f"p{a} AS MATERIALIZED (SELECT j, avg(x.z * t) / (SELECT avg(t * t) FROM t{a}) AS v FROM x JOIN t{a} USING (k) GROUP BY j)",
            f"c{a} AS MATERIALIZED (SELECT j, c{a - 1}.v - p{a}.v * (SELECT sum(u.v * q.v) FROM r{a} u JOIN c{a - 1} q USING (j)) AS v FROM c{a - 1} JOIN p{a} USING (j))",
        ]
    each = range(1, components + 1)
    fit = " + ".join(f"t{a}.t * p{a}.v" for a in each)
    out.append(f"e AS (SELECT k, sum(power(x.z - ({fit}), 2)) AS spe FROM x {' '.join(f'JOIN p{a} USING (j) JOIN t{a} USING (k)' for a in each)} GROUP BY k)")
    out.append(f"wide AS (SELECT k, {' + '.join(f't{a}.t * t{a}.t / (SELECT avg(t * t) FROM t{a})' for a in each)} AS t2, spe FROM e {' '.join(f'JOIN t{a} USING (k)' for a in each)})")
    return ", ".join(out)


# a limit is the value that 99 in 100 rows do not pass
_limit = "(SELECT {0} FROM wide ORDER BY {0} LIMIT 1 OFFSET (SELECT ceil(0.99 * count(*))::BIGINT - 1 FROM wide))".format
query("score_wide", f"SELECT k AS reading_id, round(t2, 6) AS t2, round(spe, 6) AS spe, t2 > {_limit('t2')} OR spe > {_limit('spe')} AS anomaly FROM wide", _pls_sql())(lambda s, d: mo.score(fx.readings_wide(s, d), fit_model(fx.readings_wide(s, d), 4)).select("reading_id", *r6("t2", "spe"), "anomaly"))
query("monitor_windows", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, {_mon}, {_cnt} FROM scored GROUP BY 1", fx.SCORED)(lambda s, d: monitor_stream(fx.readings(s, d), M).select("window_start", *r6(*_MON), *_CNT))


_J = range(1, 6)
_sum = lambda f: "(" + " + ".join(f(j) for j in _J) + ")"
_cross = lambda a, b: f"covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}))"
_PLS = (
    "moments AS (SELECT " + ", ".join([*(f"avg(feature{j}) AS m{j}, stddev_pop(feature{j}) AS s{j}, {_cross(f'feature{j}', 'target')} AS y{j}" for j in _J), *(f"{_cross(f'feature{j}', f'feature{k}')} AS z{j}{k}" for j in _J for k in _J)]) + " FROM readings)"
    + f", w1 AS (SELECT *, {', '.join(f'y{j} / sqrt({_sum(lambda k: f"y{k} * y{k}")}) AS a{j}' for j in _J)} FROM moments)"
    + f", t1 AS (SELECT *, {_sum(lambda j: f'a{j} * ' + _sum(lambda k: f'z{j}{k} * a{k}'))} AS l1, {_sum(lambda j: f'a{j} * y{j}')} AS ay FROM w1)"
    + f", p1 AS (SELECT *, {', '.join(f'{_sum(lambda k: f"z{j}{k} * a{k}")} / l1 AS p{j}' for j in _J)} FROM t1)"
    + f", y2 AS (SELECT *, {', '.join(f'y{j} - p{j} * ay AS d{j}' for j in _J)} FROM p1)"
    + f", w2 AS (SELECT *, {', '.join(f'd{j} / sqrt({_sum(lambda k: f"d{k} * d{k}")}) AS v{j}' for j in _J)} FROM y2)"
    + f", r2 AS (SELECT *, {', '.join(f'v{j} - {_sum(lambda k: f"p{k} * v{k}")} * a{j} AS b{j}' for j in _J)} FROM w2)"
    + f", t2 AS (SELECT *, {_sum(lambda j: f'b{j} * ' + _sum(lambda k: f'z{j}{k} * b{k}'))} AS l2 FROM r2)"
    + f", fit AS (SELECT *, {', '.join(f'{_sum(lambda k: f"z{j}{k} * b{k}")} / l2 AS q{j}' for j in _J)} FROM t2)"
)


@query("fit_model", " UNION ALL ".join(f"SELECT 'feature{j}' AS feature, {', '.join(f'round({c}, 5) AS {n}' for c, n in ((f'm{j}', 'mean'), (f's{j}', 'scale'), (f'a{j}', 'rotation1'), (f'b{j}', 'rotation2'), (f'p{j}', 'loading1'), (f'q{j}', 'loading2'), ('l1', 'variance1'), ('l2', 'variance2')))} FROM fit" for j in _J), f"{fx.READINGS}, {_PLS}")
def _fit(s, d):
    m = fit_model(fx.readings(s, d))
    rows = [(n, *(round(float(x), 5) for x in (a, b, *r, *p, *m.eigenvalues))) for n, a, b, r, p in zip(m.names, m.x_mean, m.x_scale, m.rotations, m.loadings, strict=True)]
    return s.createDataFrame(rows, "feature string, " + ", ".join(f"{c} double" for c in ("mean", "scale", "rotation1", "rotation2", "loading1", "loading2", "variance1", "variance2")))


# Text

query("text_profile", "SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS lines, len(regexp_extract_all(text, '[^\\s\\x1c-\\x1f\\x{85}\\p{Z}]+')) AS words, replace(substr(text, 1, 200), chr(10), ' ') AS preview FROM docs", fx.DOCS)(lambda s, d: fx.documents(s, d).select("doc_id", *(c.alias(k) for k, c in tx.text_profile("text").items())))
query("chunk_fixed", "SELECT doc_id, chunk_pos, text FROM chunks", fx.CHUNKS)(lambda s, d: fx.chunks(s, d).select("doc_id", "chunk_pos", "text"))
_dense = "cut AS (SELECT doc_id, list_filter(list_transform(list_sort(list_concat(range(0, length(text), 300), CASE WHEN length(text) % 300 > 120 AND length(text) % 300 < 240 THEN [length(text) - length(text) % 300 + 120] ELSE [] END)), lambda s: " + fx.STRIP.format("substr(text, s + 1, 300)") + "), lambda c: c <> '') AS pieces FROM docs)"
query("chunk_fixed_overlapping", "SELECT doc_id, pos AS chunk_pos, pieces[pos + 1] AS text FROM (SELECT *, unnest(range(0, len(pieces))) AS pos FROM cut)", f"{fx.DOCS}, {_dense}")(lambda s, d: ch.chunk_documents(fx.documents(s, d), "fixed", size=300, overlap=180).select("doc_id", "chunk_pos", "text"))
query("chunk_semantic", f"SELECT doc_id, pos AS chunk_pos, pieces[pos + 1] AS text FROM (SELECT doc_id, pieces, unnest(range(0, len(pieces))) AS pos FROM (SELECT doc_id, {fx.semantic('replace(text, chr(10), chr(10) || chr(10))')} AS pieces FROM docs))", fx.DOCS)(lambda s, d: ch.chunk_documents(fx.documents(s, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), "semantic").select("doc_id", "chunk_pos", "text"))
query("split_sentences", "SELECT doc_id, pos AS at, pieces[pos + 1] AS sentence FROM (SELECT doc_id, pieces, unnest(range(0, len(pieces))) AS pos FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[^。！？.!?]*[。！？.!?]+\\s*|[^。！？.!?]+'), lambda x: " + fx.STRIP.format("x") + " <> '') AS pieces FROM docs))", fx.DOCS)(lambda s, d: fx.documents(s, d).select("doc_id", F.posexplode(tx.split_sentences("text")).alias("at", "sentence")))
query("assign_chunk_index", "SELECT doc_id, chunk_pos, row_number() OVER (ORDER BY file_path, doc_id, chunk_pos) - 1 AS chunk_index FROM chunks", fx.CHUNKS)(lambda s, d: ch.assign_chunk_index(fx.chunks(s, d)).select("doc_id", "chunk_pos", "chunk_index"))
_ps = "SELECT d.doc_id, d.file_path, length(d.text) AS chars, count(c.doc_id) AS chunks, count(c.doc_id) = 0 AS failed, array_to_string(list(c.text ORDER BY c.chunk_pos) FILTER (WHERE c.chunk_pos < 3), chr(10)) AS first_chunks FROM docs d LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY ALL"
query("processing_stats", _ps, fx.CHUNKS)(lambda s, d: ch.processing_stats(fx.documents(s, d), fx.chunks(s, d)).withColumn("first_chunks", F.array_join("first_chunks", "\n")))
query("processing_totals", f"SELECT count(*) AS total_files, count(*) FILTER (WHERE NOT failed) AS processed, count(*) FILTER (WHERE failed) AS failed_files, sum(chunks)::BIGINT AS total_chunks FROM ({_ps})", fx.CHUNKS)(lambda s, d: ch.processing_totals(ch.processing_stats(fx.documents(s, d), fx.chunks(s, d))))
query("tokenize", f"SELECT doc_id, array_to_string({fx.TOKENS.format('text')}, ' ') AS tokens FROM docs", fx.DOCS)(lambda s, d: fx.documents(s, d).select("doc_id", F.array_join(tx.tokenize("text"), " ").alias("tokens")))
query("ngrams", "SELECT doc_id, term, tf FROM counts", fx.DOCS + ", " + fx.terms("docs", "doc_id", "text", "counts"))(lambda s, d: tf.term_counts(fx.documents(s, d), "doc_id"))

# TF-IDF and search


def index(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return tf.build_index(fx.chunks(s, d))


query("fit_vocabulary", "SELECT term, total::BIGINT AS total, df, round(idf, 6) AS idf FROM vocab", fx.INDEX)(lambda s, d: tf.fit_vocabulary(fx.chunks(s, d)).select("term", "total", "df", *r6("idf")))
query("tfidf_vectors", "SELECT chunk_id, term, round(weight, 6) AS weight FROM vectors", fx.INDEX)(lambda s, d: index(s, d)["vectors"].select("chunk_id", "term", *r6("weight")))
@query("append_texts", "SELECT chunk_id, term, round(weight, 6) AS weight FROM vectors", fx.INDEX)
def _grown(s: SparkSession, d: str) -> DataFrame:
    """The chunks of odd documents appended to the index of the others."""
    c = fx.chunks(s, d)
    grown = tf.append_texts(tf.build_index(c.filter("doc_id % 2 = 0"), growable=True), c.filter("doc_id % 2 <> 0"))
    return grown["vectors"].select("chunk_id", "term", *r6("weight"))


query("embed_queries", "SELECT query_id, term, round(weight, 6) AS weight FROM qvec", fx.EMBEDDED)(lambda s, d: tf.embed(fx.queries(s, d).withColumnRenamed("query", "text"), tf.fit_vocabulary(fx.chunks(s, d)), "query_id").select("query_id", "term", *r6("weight")))
query("index_stats", "SELECT (SELECT count(*) FROM chunks) AS total_chunks, (SELECT count(DISTINCT source_file) FROM chunks) AS n_sources, (SELECT string_agg(source_file, ',' ORDER BY source_file) FROM (SELECT DISTINCT source_file FROM chunks)) AS sources, (SELECT count(*) FROM vocab) AS dimension, (SELECT count(*) FROM vectors) AS index_size", fx.INDEX)(lambda s, d: tf.index_stats(index(s, d)))
query("sample_chunks", "SELECT chunk_id, text FROM chunks ORDER BY md5('0|' || chunk_id), chunk_id LIMIT 5", fx.CHUNKS)(lambda s, d: tf.sample_chunks(fx.chunks(s, d), 5).select("chunk_id", "text"))
query("blank_query_guard", "SELECT query_id, query FROM asked", fx.QUERIES + ", asked AS (SELECT * FROM queries WHERE " + fx.STRIP.format("query") + " <> '')")(lambda s, d: se.blank_query_guard(fx.queries(s, d)))
_l2 = ", dots AS (SELECT query_id, chunk_id, sum(q.weight * v.weight) AS dot FROM qvec q JOIN vectors v USING (term) GROUP BY ALL), unit AS (SELECT DISTINCT chunk_id FROM vectors), known AS (SELECT DISTINCT query_id FROM qvec), d2 AS (SELECT a.query_id, c.chunk_id, (CASE WHEN k.query_id IS NULL THEN 0 ELSE 1 END) + (CASE WHEN u.chunk_id IS NULL THEN 0 ELSE 1 END) - 2 * coalesce(dot, 0) AS d2 FROM asked a CROSS JOIN chunks c LEFT JOIN known k ON k.query_id = a.query_id LEFT JOIN unit u ON u.chunk_id = c.chunk_id LEFT JOIN dots d ON d.query_id = a.query_id AND d.chunk_id = c.chunk_id), hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + d2), 9) DESC, chunk_id) AS rank, chunk_id, round(1 / (1 + d2), 9) AS score FROM d2 QUALIFY rank <= 25)"
query("search_tfidf_l2", "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits WHERE rank <= 5", fx.EMBEDDED + _l2)(lambda s, d: se.search_tfidf_l2(fx.queries(s, d), index(s, d), 5).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", *r6("score")))


@query("read_index", "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits WHERE rank <= 5", fx.EMBEDDED + _l2)
def _reloaded(s, d):
    path = f"{shared_dir(s)}/index-{uuid.uuid4().hex}"
    write_index(path, index(s, d))
    return se.search_tfidf_l2(fx.queries(s, d), read_index(s, path), 5).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", *r6("score"))


query("attach_metadata", "SELECT query_id, rank, chunk_id, source_file, file_path, text FROM hits JOIN chunks USING (chunk_id) WHERE rank <= 3", fx.EMBEDDED + _l2)(lambda s, d: se.attach_metadata(se.search_tfidf_l2(fx.queries(s, d), i := index(s, d), 3), i["chunks"]).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "source_file", "file_path", "text"))
query("search_by_source", "SELECT query_id, n AS rank, chunk_id, round(score, 6) AS score FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY h.rank) AS n FROM hits h JOIN chunks USING (chunk_id) WHERE source_file = 'src3') WHERE n <= 5", fx.EMBEDDED + _l2)(lambda s, d: se.search_by_source(fx.queries(s, d), index(s, d), "src3", 5).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", *r6("score")))


def dense(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = fx.table(s, d, "embeddings").select("vec_id", "embedding")
    return v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), v


_dense_sql = "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id, round({0}, 9) AS score FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 20 = 0) QUALIFY rank <= 5"
query("search_l2", _dense_sql.format("1 / (1 + power(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 2))"))(lambda s, d: se.search_l2(*dense(s, d), 5).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", *r6("score")))
query("search_dense_cosine", _dense_sql.format("list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"))(lambda s, d: se.search_dense_cosine(*dense(s, d), 5).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", *r6("score")))


@query("pairwise_cosine", "SELECT a_id, b_id, round(c, 6) AS cosine, CASE WHEN c > 0.9 THEN '0.9' WHEN c > 0.8 THEN '0.8' WHEN c > 0.7 THEN '0.7' WHEN c > 0.5 THEN '0.5' ELSE 'low' END AS band FROM (SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def _pairs(s, d):
    v = fx.table(s, d, "embeddings")
    a, b = v.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a")), v.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    return se.pairwise_cosine(a.join(b, F.col("b_id") == F.col("a_id") + 1)).select("a_id", "b_id", *r6("cosine"), "band")


@query("similarity_ratio", "SELECT a.vec_id, round(c1 / nullif(c2, 0), 5) AS ratio FROM (SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c1, round(list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS c2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2) a")
def _ratio(s, d):
    v = fx.table(s, d, "embeddings")
    named = lambda n, i: v.select((F.col("vec_id") - i).alias("vec_id"), F.col("embedding").alias(n))
    c = named("a", 0).join(named("b", 1), "vec_id").join(named("c", 2), "vec_id")
    c = c.select("vec_id", F.round(se.cosine("a", "b"), 9).alias("c1"), F.round(se.cosine("a", "c"), 9).alias("c2"))
    return c.select("vec_id", F.round(se.similarity_ratio("c1", "c2"), 5).alias("ratio"))


@query("append_index", "SELECT label AS part, count(*) AS n FROM embeddings GROUP BY label")
def _append(s, d):
    v = fx.table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    old, new = v.filter("label < 5"), v.filter("label >= 5")
    chunks, vectors = append_index(old.select("chunk_id", "label"), old.select("chunk_id", "embedding"), new.select("chunk_id", "label"), new.select("chunk_id", "embedding"))
    return chunks.join(vectors, "chunk_id").groupBy(F.col("label").alias("part")).agg(F.count(F.lit(1)).alias("n"))


# Ranges from cells: a range for each reading, from its time on, some twenty days long at most; they overlap by the thousand


def many_ranges(s: SparkSession, d: str) -> DataFrame:
    r = fx.readings(s, d)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return r.select(F.col("reading_id").alias("range_id"), text("ts").alias("start_time"), text(F.col("ts") + F.make_interval(secs=F.pmod(F.col("feature1"), F.lit(500)) * 3607)).alias("end_time"))


_many = "many AS (SELECT reading_id AS range_id, ts AS a, ts + to_seconds((feature1::BIGINT % 500) * 3607) AS b FROM readings)"
# values have two digits: a mean may be an exact half of the fifth, which the shift decides for both engines
query("stats_by_cells", "SELECT range_id, 'ok' AS status, count(*) AS count, round(avg(target) + 3e-7, 4) AS target_mean, max(target) AS target_max, min(target) AS target_min, round(stddev_samp(target), 4) AS target_std FROM many JOIN readings r ON r.ts BETWEEN a AND b GROUP BY range_id", f"{fx.READINGS}, {_many}")(lambda s, d: mm.stats_by_cells(fx.readings(s, d), many_ranges(s, d)).select("range_id", "status", "count", F.round(F.col("target_mean") + 3e-7, 4).alias("target_mean"), "target_max", "target_min", *r6("target_std", digits=4)))
_cell_stats = ", ".join(f"round({f}({v}), 4) AS {v}_{n}" for v in ("t2", "spe") for f, n in (("avg", "mean"), ("max", "max"), ("min", "min"), ("stddev_pop", "std")))
query("monitor_by_cells", f"SELECT range_id, count(*) AS total, count(*) FILTER (WHERE anomaly) AS anomalies, count(*) FILTER (WHERE t2_anomaly) AS t2_anomalies, count(*) FILTER (WHERE spe_anomaly) AS spe_anomalies, {_cell_stats} FROM many JOIN scored r ON r.ts BETWEEN a AND b GROUP BY range_id", f"{fx.SCORED}, {_many}")(lambda s, d: mm.monitor_by_cells(scored(s, d), many_ranges(s, d)).select("range_id", "total", "anomalies", "t2_anomalies", "spe_anomalies", *r6(*(f"{v}_{n}" for v in ("t2", "spe") for n in ("mean", "max", "min", "std")), digits=4)))


_over = "over AS (SELECT range_id, start_ts, end_ts FROM ranges WHERE start_ts <= end_ts AND end_ts < (SELECT max(ts) FROM readings) - INTERVAL 10 MINUTE)"
_watched = ", ".join(f"round({f}({v}), 6) AS {v}_{n}" for v in ("t2", "spe") for f, n in (("avg", "mean"), ("max", "max"), ("min", "min"), ("stddev_pop", "std")))


@query("watch_ranges", f"SELECT range_id, count(*) AS total_samples, count(*) FILTER (WHERE anomaly) AS anomaly_count, count(*) FILTER (WHERE t2_anomaly) AS t2_count, count(*) FILTER (WHERE spe_anomaly) AS spe_count, {_watched}, min(ts) FILTER (WHERE anomaly) AS first_ts, arg_min(reading_id, (ts, reading_id)) FILTER (WHERE anomaly) AS first_reading_id, CASE WHEN bool_or(anomaly) THEN min(place) FILTER (WHERE anomaly) END AS position FROM (SELECT *, row_number() OVER (PARTITION BY range_id ORDER BY ts, reading_id) - 1 AS place FROM over JOIN scored r ON r.ts BETWEEN start_ts AND end_ts) GROUP BY range_id", f"{fx.SCORED}, {fx.RANGES_SQL}, {_over}")
def _watch(s: SparkSession, d: str) -> DataFrame:
    """All readings through a stream; ranges that the last one has left behind by the watermark are over."""
    out = replay(fx.readings(s, d), fx.ranges(s), M, f"{shared_dir(s)}/watched-{uuid.uuid4().hex}")
    stats = [f"{v}_{k}" for v in ("t2", "spe") for k in ("mean", "max", "min", "std")]
    return out.select("range_id", "total_samples", "anomaly_count", "t2_count", "spe_count", *r6(*stats), "first_ts", "first_reading_id", "position")


# Knowledge


def kb(s: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    k = fx.knowledge(s, d)
    return k, kn.build_kb_index(materialize(kn.kb_documents(k["features"], k["solutions"], k["concepts"]), "kb"))


def hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "kb_id", *r6("score"))


query("kb_documents", "SELECT kb_id, type, key, priority, text FROM kb", fx.KB)(lambda s, d: kn.kb_documents(*fx.knowledge(s, d).values()))
query("kb_stats", "SELECT (SELECT count(*) FROM features) AS features_count, (SELECT count(*) FROM solutions) AS solutions_count, (SELECT count(*) FROM concepts) AS concepts_count, (SELECT count(*) FROM conversations WHERE role = 'system') AS best_practices_count, (SELECT count(*) FROM conversations WHERE role = 'user' AND turn > 0) AS tips_count", fx.KNOWLEDGE)(lambda s, d: kn.kb_stats(fx.knowledge(s, d) | fx.advice(s, d)))
_names = "names AS (SELECT DISTINCT 'feature' || (p_partkey * 2 + 1) AS feature_name FROM part)"


def names(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "part").select(F.concat(F.lit("feature"), (F.col("p_partkey") * 2 + 1).cast("string")).alias("feature_name")).distinct()


query("lookup_features", "SELECT feature_name, name, unit, related_to FROM names JOIN features USING (feature_name)", f"{fx.KNOWLEDGE}, {_names}")(lambda s, d: kn.lookup_features(names(s, d), fx.knowledge(s, d)["features"]).select("feature_name", "name", "unit", "related_to"))
query("explain_features", "SELECT n.feature_name, coalesce(name, n.feature_name) AS name, coalesce(description, '该特征的物理含义暂未录入知识库') AS description, coalesce(unit, '') AS unit, coalesce(related_to, '') AS related_to, coalesce(array_to_string(anomaly_causes, '|'), '') AS causes, coalesce(impact, '') AS impact FROM names n LEFT JOIN features USING (feature_name)", f"{fx.KNOWLEDGE}, {_names}")(lambda s, d: kn.explain_features(names(s, d), fx.knowledge(s, d)["features"]).select("feature_name", "name", "description", "unit", "related_to", F.array_join("anomaly_causes", "|").alias("causes"), "impact"))
query("solutions_by_priority", "SELECT solution_id, problem FROM solutions WHERE priority = 'high'", fx.KNOWLEDGE)(lambda s, d: kn.solutions_by_priority(fx.knowledge(s, d)["solutions"], "high").select("solution_id", "problem"))
_hay = "lower(problem || ' ' || array_to_string(symptoms, ' ') || ' ' || array_to_string(root_causes, ' '))"
query("solutions_by_keyword", f"SELECT solution_id FROM solutions WHERE contains({_hay}, 'tion') OR contains({_hay}, 'the')", fx.KNOWLEDGE)(lambda s, d: kn.solutions_by_keyword(fx.knowledge(s, d)["solutions"], ["TION", "the"]).select("solution_id"))
query("solutions_by_keyword_table", f"SELECT solution_id FROM solutions s WHERE EXISTS (SELECT 1 FROM concepts c WHERE contains({_hay}, lower(c.term)))", fx.KNOWLEDGE)(lambda s, d: kn.solutions_by_keyword((k := fx.knowledge(s, d))["solutions"], k["concepts"].select(F.col("term").alias("keyword"))).select("solution_id"))


@query("concept_by_term", "SELECT upper(term) AS term_query, concept_id, definition FROM concepts QUALIFY row_number() OVER (PARTITION BY upper(term) ORDER BY concept_id) = 1", fx.KNOWLEDGE)
def _concept(s: SparkSession, d: str) -> DataFrame:
    """Each term asked for in capitals, letter by letter: F.upper makes two letters of some, which are another word."""
    c = fx.knowledge(s, d)["concepts"]
    return kn.concept_by_term(c.select(tx.capitals("term").alias("term_query")).distinct(), c).select("term_query", "concept_id", "definition")


_ask = fx.KB_INDEX + ", " + fx.QUERIES + ", asked AS (SELECT * FROM queries WHERE " + fx.STRIP.format("query") + " <> '')"


def asked(s: SparkSession, d: str) -> DataFrame:
    return se.blank_query_guard(fx.queries(s, d))


_hits = "SELECT query_id, rank, kb_id, round(score, 6) AS score FROM hits"
query("search_cosine", _hits, f"{_ask}, {fx.cosine_search('asked', 5)}")(lambda s, d: hits(se.search_cosine(asked(s, d), kb(s, d)[1], 5)))
query("filter_doc_type", _hits, f"{_ask}, {fx.cosine_search('asked', 3, chr(39).join(['type = ', 'feature', '']))}")(lambda s, d: hits(kn.search_typed(asked(s, d), kb(s, d)[1], "feature", 3)))
query("search_concepts", _hits, f"{_ask}, {fx.cosine_search('asked', 3, chr(39).join(['type = ', 'concept', '']))}")(lambda s, d: hits(kn.search_concepts(asked(s, d), kb(s, d)[1])))
query("search_knowledge", "SELECT query_id, rank, kb_id AS hit, round(score, 6) AS score, 'knowledge' AS source FROM hits", f"{_ask}, {fx.cosine_search('asked', 3, chr(39).join(['type = ', 'solution', '']))}")(lambda s, d: kn.search_knowledge(fx.queries(s, d), kb(s, d)[1], kind="solution").select("query_id", F.col("rank").cast("long").alias("rank"), "hit", *r6("score"), "source"))
_sets = "sets AS (SELECT p_partkey AS query_id, ['feature' || (p_partkey + 1), 'feature' || (p_partkey * 7 + 1)] AS feature_names FROM part WHERE p_partkey % 20 = 0)"


def sets(s: SparkSession, d: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("feature"), (c + 1).cast("string"))
    k = F.col("p_partkey")
    return fx.table(s, d, "part").filter("p_partkey % 20 = 0").select(k.alias("query_id"), F.array(name(k), name(k * 7)).alias("feature_names"))


_more = "more AS (SELECT query_id, string_agg(name || ' ' || related_to, ' ' ORDER BY nth) AS more FROM (SELECT query_id, unnest([1, 2]) AS nth, unnest(feature_names) AS feature_name FROM sets) JOIN features USING (feature_name) GROUP BY query_id)"
_probs = "asked AS (SELECT query_id, concat_ws(' ', array_to_string(feature_names, ', ') || ' 异常', more) AS query FROM sets LEFT JOIN more USING (query_id))"
_sol = f"{fx.KB_INDEX}, {_sets}, {_more}, {_probs}, "


def problems(s: SparkSession, d: str) -> DataFrame:
    return sets(s, d).withColumn("problem", F.concat(F.array_join("feature_names", ", "), F.lit(" 异常")))


_only_sol = "type = 'solution'"
query("find_solutions", _hits, _sol + fx.cosine_search("asked", 3, _only_sol))(lambda s, d: hits(kn.find_solutions(problems(s, d), (k := kb(s, d))[0]["features"], k[1])))
query("explain_with_solutions", "SELECT query_id, rank, problem, priority, array_to_string(s.solutions[1:3], '|') AS fixes FROM hits JOIN solutions s ON kb_id = 'solution:' || lpad(solution_id::VARCHAR, 12, '0')", _sol + fx.cosine_search("asked", 2, _only_sol))(lambda s, d: kn.explain_with_solutions(sets(s, d), (k := kb(s, d))[0]["features"], k[0]["solutions"], k[1]).select("query_id", F.col("rank").cast("long").alias("rank"), "problem", "priority", F.array_join("solutions", "|").alias("fixes")))
_rel = "asked AS (SELECT query_id, string_agg(name, ' ' ORDER BY nth) AS query FROM (SELECT query_id, unnest([1, 2]) AS nth, unnest(feature_names) AS feature_name FROM sets) JOIN features USING (feature_name) GROUP BY query_id)"
query("related_features", "SELECT query_id, h.rank, replace(kb_id, 'feature:', '') AS feature_name, round(score, 6) AS score FROM hits h JOIN sets USING (query_id) WHERE NOT list_contains(feature_names, replace(kb_id, 'feature:', ''))", f"{fx.KB_INDEX}, {_sets}, {_rel}, " + fx.cosine_search("asked", 3, "type = 'feature'"))(lambda s, d: kn.related_features(sets(s, d), (k := kb(s, d))[0]["features"], k[1]).select("query_id", F.col("rank").cast("long").alias("rank"), "feature_name", *r6("score")))


def anomalies(s: SparkSession, d: str) -> DataFrame:
    return mo.explain(scored(s, d), M).select(F.col("reading_id").alias("anomaly_id"), "t2_anomaly", "spe_anomaly", "t2_top", "spe_top")


query("anomaly_feature_set", "SELECT reading_id AS anomaly_id, string_agg(feature, ',' ORDER BY o) AS feature_names FROM (SELECT *, row_number() OVER (PARTITION BY reading_id ORDER BY o) AS n FROM (SELECT reading_id, feature, min(o) AS o FROM (SELECT reading_id, feature, CASE WHEN stat = 't2' THEN rank ELSE 3 + rank END AS o FROM top) GROUP BY ALL)) WHERE n <= 5 GROUP BY reading_id", f"{fx.SCORED}, {_long}")(lambda s, d: anomalies(s, d).select("anomaly_id", F.array_join(kn.anomaly_feature_set(), ",").alias("feature_names")))


_FS = f"{fx.SCORED}, {_long}, fs AS (SELECT reading_id AS anomaly_id, list(feature ORDER BY o) AS fl FROM (SELECT *, row_number() OVER (PARTITION BY reading_id ORDER BY o) AS n FROM (SELECT reading_id, feature, min(CASE WHEN stat = 't2' THEN rank ELSE 3 + rank END) AS o FROM top GROUP BY ALL)) WHERE n <= 5 GROUP BY reading_id), sets AS (SELECT fl, row_number() OVER () AS query_id FROM (SELECT DISTINCT fl FROM fs))"
_KNOWN = "known AS (SELECT query_id, list(feature_name ORDER BY nth) AS explained, string_agg(name || ' ' || related_to, ' ' ORDER BY nth) AS more, list(feature_name || '(' || name || '): ' || impact ORDER BY nth) AS lines FROM (SELECT query_id, unnest(range(1, len(fl) + 1)) AS nth, unnest(fl) AS feature_name FROM sets) JOIN features USING (feature_name) GROUP BY query_id)"
_PROBLEM = "asked AS (SELECT query_id, concat_ws(' ', '异常检测 ' || array_to_string(fl, ', ') || ' 异常', more) AS query FROM sets LEFT JOIN known USING (query_id))"
_fixed = fx.cosine_search("fixed", 1, "type = 'concept'")
for _old, _new in (("qcounts", "fcounts"), ("qvec", "fvec"), ("dots", "fdots"), ("hits", "fhits")):
    _fixed = _fixed.replace(_old, _new)
_REC = f"{_FS}, {fx.KB_INDEX}, {_KNOWN}, {_PROBLEM}, {fx.cosine_search('asked', 3, _only_sol)}, fixed AS (SELECT * FROM (VALUES (1, 'T2统计量 异常'), (2, 'SPE统计量 异常')) v(query_id, query)), {_fixed}, sols AS (SELECT query_id, list(kb_id ORDER BY rank) AS s FROM hits GROUP BY query_id), made AS (SELECT f.anomaly_id, f.fl, k.explained, k.lines, s.s, t2_anomaly, spe_anomaly FROM fs f JOIN sets USING (fl) LEFT JOIN known k USING (query_id) LEFT JOIN sols s USING (query_id) JOIN scored ON reading_id = anomaly_id)"
_listed = "coalesce(array_to_string({0}, ','), '')".format


@query("recommend", f"SELECT anomaly_id, {_listed('fl')} AS feature_names, {_listed('explained')} AS explained, {_listed('s')} AS solutions, {_listed('list_filter([CASE WHEN t2_anomaly THEN (SELECT kb_id FROM fhits WHERE query_id = 1) END, CASE WHEN spe_anomaly THEN (SELECT kb_id FROM fhits WHERE query_id = 2) END], lambda x: x IS NOT NULL)')} AS concepts, coalesce(len(s), 0) > 0 AS has_recommendations FROM made", _REC)
def _recommend(s, d):
    k, i = kb(s, d)
    out = kn.recommend(materialize(anomalies(s, d), "anomalies"), k["features"], i)
    return out.select("anomaly_id", *(F.array_join(c, ",").alias(c) for c in ("feature_names", "explained", "solutions", "concepts")), "has_recommendations")


_micro = "round({0} * 1000000)::BIGINT".format
_FULL = (
    f"{_REC}, expl AS (SELECT query_id, string_agg(concat_ws('|', feature_name, name, description, unit, normal_range, related_to, array_to_string(anomaly_causes, ';'), impact), chr(10) ORDER BY nth) AS e FROM (SELECT query_id, unnest(range(1, len(fl) + 1)) AS nth, unnest(fl) AS feature_name FROM sets) JOIN features USING (feature_name) GROUP BY query_id)"
    f", fsol AS (SELECT query_id, string_agg(concat_ws('|', problem, array_to_string(symptoms, ';'), array_to_string(root_causes, ';'), array_to_string(s.solutions, ';'), priority, '1d', {_micro('score')}), chr(10) ORDER BY rank) AS fs FROM hits JOIN solutions s ON kb_id = 'solution:' || lpad(solution_id::VARCHAR, 12, '0') GROUP BY query_id)"
    f", fcon AS (SELECT query_id AS n, concat_ws('|', term, definition, interpretation, category, {_micro('score')}) AS fc FROM fhits JOIN concepts ON kb_id = 'concept:' || lpad(concept_id::VARCHAR, 12, '0'))"
)


@query("recommend_full", "SELECT f.anomaly_id, coalesce(e, '') AS explanations, coalesce(fs, '') AS solutions, concat_ws(chr(10), CASE WHEN t2_anomaly THEN (SELECT fc FROM fcon WHERE n = 1) END, CASE WHEN spe_anomaly THEN (SELECT fc FROM fcon WHERE n = 2) END) AS concepts FROM fs f JOIN sets USING (fl) LEFT JOIN expl USING (query_id) LEFT JOIN fsol USING (query_id) JOIN scored ON reading_id = f.anomaly_id", _FULL)
def _recommend_full(s, d):
    """Explanations, solutions and concepts with all their fields."""
    k, i = kb(s, d)
    out = kn.recommend(materialize(anomalies(s, d), "anomalies"), k["features"], i, k)
    field = lambda x, n, listed: F.array_join(x[n], ";") if n in listed else F.round(x[n] * 1_000_000).cast("long").cast("string") if n == "relevance_score" else x[n]
    lines = lambda c, names, *listed: F.array_join(F.transform(c, lambda x: F.concat_ws("|", *(field(x, n, listed) for n in names))), "\n")
    explained = lines("explanations", ("feature_name", *kn.FIELDS), "anomaly_causes")
    solved = lines("found_solutions", (*kn.SOLUTION_FIELDS, "relevance_score"), "symptoms", "root_causes", "solutions")
    return out.select("anomaly_id", explained.alias("explanations"), solved.alias("solutions"), lines("found_concepts", (*kn.CONCEPT_FIELDS, "relevance_score")).alias("concepts"))


@query("recommendation_summary", "SELECT anomaly_id, '检测到异常，主要涉及特征: ' || array_to_string(fl, ', ') || '。' || coalesce(array_to_string(lines[1:2], ' '), '') AS summary FROM made", _REC)
def _summary(s, d):
    k, i = kb(s, d)
    return kn.recommend(materialize(anomalies(s, d), "anomalies"), k["features"], i).select("anomaly_id", "summary")
