"""Inputs of the registered queries, derived from the driver's tables, and the same derivations in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.chunks import chunk_documents
from plumbline.operators.model import Model
from plumbline.sources.shared import spread

#: Two components over the five features of readings_events.
MODEL = Model(
    x_mean=(75.0, 50.0, 11.5, 29.5, 29.5), x_scale=(43.0, 29.0, 7.0, 17.0, 17.0),
    pls_mean=(0.01, -0.02, 0.0, 0.03, 0.01), pls_std=(1.1, 0.9, 1.0, 1.05, 0.95),
    rotations=((0.5, 0.1), (0.4, -0.3), (-0.3, 0.6), (0.2, 0.5), (0.6, -0.2)),
    loadings=((0.45, 0.15), (0.35, -0.25), (-0.35, 0.55), (0.25, 0.45), (0.55, -0.15)),
    eigenvalues=(1.1, 0.9), ucl_t2=4.5, ucl_spe=6.0,
)
RANGES = [
    (1, "2024-01-01 00:00:00", "2024-01-01 23:59:59"), (2, "2024-01-03T00:00:00", "2024-01-09T23:59:59"), (3, "2024-01-08 12:00:00", "2024-01-12 00:00:00"),
    (4, "2026-01-01 00:00:00", "2026-02-01 00:00:00"), (5, "2024-01-12 00:00:00", "2024-01-02 00:00:00"), (6, "not a time", "2024-01-02 00:00:00"), (7, "2024-01-01 00:00:00", "2024-01-30 23:59:59"),
]
DAY = ("2024-01-03 06:00:00", "2024-01-05T18:30:00")
CHUNK = {"size": 500, "overlap": 50}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    d = lambda c: c.cast("double")
    ts = F.col("ts").cast("timestamp_ntz")
    return e.select(F.col("event_id").alias("reading_id"), ts.alias("ts"), d(F.col("value")).alias("target"), d(F.col("user_id")).alias("feature1"), d(F.regexp_extract("props", r"(\d+)", 1)).alias("feature2"), d(F.hour(ts)).alias("feature3"), d(F.minute(ts)).alias("feature4"), d(F.second(ts)).alias("feature5"))


def readings_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 features from the embeddings, a second apart."""
    e = table(spark, sf_dir, "embeddings")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id")).cast("timestamp_ntz")
    return e.select(F.col("vec_id").alias("reading_id"), at.alias("ts"), F.col("label").cast("double").alias("target"), *(F.col("embedding")[i].cast("double").alias(f"feature{i + 1}") for i in range(64)))


def ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RANGES, "range_id long, start_time string, end_time string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("source").alias("source_file"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk_documents(documents(spark, sf_dir), "fixed", **CHUNK)
    return c.withColumn("chunk_id", F.col("doc_id") * 100_000 + F.col("chunk_pos"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts, one of unknown words and a blank one."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query"))
    return b.union(spark.createDataFrame([(1_000_001, "qqzzqq xxyyxx"), (1_000_002, "  \n ")], "query_id long, query string"))


def knowledge(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    p = spread(table(spark, sf_dir, "part"))
    feats = p.select(F.concat(F.lit("feature"), (F.col("p_partkey") + 1).cast("string")).alias("feature_name"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.concat(F.lit("u"), F.col("p_size").cast("string")).alias("unit"), F.lit("0-1").alias("normal_range"), F.col("p_brand").alias("related_to"), F.split("p_name", " ").alias("anomaly_causes"), F.col("p_type").alias("impact"))
    c = table(spark, sf_dir, "conversations")
    said = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    s = c.groupBy(F.col("conv_id").alias("solution_id")).agg(said("user").alias("u"), said("system").alias("root_causes"), said("assistant").alias("solutions"))
    pick = F.element_at(F.array(*(F.lit(x) for x in ("critical", "high", "medium", "low"))), (F.col("solution_id") % 4 + 1).cast("int"))
    sols = s.select("solution_id", F.coalesce(F.get("u", F.lit(0)), F.lit("")).alias("problem"), F.slice("u", 2, F.greatest(F.size("u") - 1, F.lit(0))).alias("symptoms"), "root_causes", "solutions", pick.alias("priority"), F.lit("1d").alias("typical_resolution_time"))
    cons = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("concept_id"), F.substring_index("text", " ", 1).alias("term"), F.col("text").alias("definition"), F.lit("").alias("interpretation"), F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("category"))
    return {"features": feats, "solutions": sols, "concepts": cons}


def advice(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The two lists of plain texts of a knowledge base."""
    c = table(spark, sf_dir, "conversations")
    return {"best_practices": c.filter("role = 'system'").select("text"), "tips": c.filter("role = 'user' and turn > 0").select("text")}


# The same in SQL, as named common table expressions.

_J, _A = range(5), range(2)
_m = MODEL
READINGS = "readings AS (SELECT event_id AS reading_id, ts, CAST(value AS DOUBLE) AS target, CAST(user_id AS DOUBLE) AS feature1, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS feature2, CAST(hour(ts) AS DOUBLE) AS feature3, CAST(minute(ts) AS DOUBLE) AS feature4, CAST(second(ts) AS DOUBLE) AS feature5 FROM events)"
SCORED = (
    READINGS
    + ", z AS (SELECT *, " + ", ".join(f"(feature{j + 1} - {_m.x_mean[j]}::DOUBLE) / {_m.x_scale[j]}::DOUBLE AS z{j}" for j in _J) + " FROM readings)"
    + ", tt AS (SELECT *, " + ", ".join(" + ".join(f"((z{j} - ({_m.pls_mean[j]})::DOUBLE) / {_m.pls_std[j]}::DOUBLE) * ({_m.rotations[j][a]})::DOUBLE" for j in _J) + f" AS t{a}" for a in _A) + " FROM z)"
    + ", ee AS (SELECT *, " + ", ".join(f"z{j} - (" + " + ".join(f"t{a} * ({_m.loadings[j][a]})::DOUBLE" for a in _A) + f") AS e{j}" for j in _J) + " FROM tt)"
    + ", stat AS (SELECT *, " + " + ".join(f"t{a} * t{a} / {_m.eigenvalues[a]}::DOUBLE" for a in _A) + " AS t2, " + " + ".join(f"e{j} * e{j}" for j in _J) + " AS spe, "
    + ", ".join(" + ".join(f"power(t{a} * ({_m.loadings[j][a]})::DOUBLE, 2) / {_m.eigenvalues[a]}::DOUBLE" for a in _A) + f" AS c{j}" for j in _J) + " FROM ee)"
    + f", scored AS (SELECT *, t2 > {_m.ucl_t2} AS t2_anomaly, spe > {_m.ucl_spe} AS spe_anomaly, t2 > {_m.ucl_t2} OR spe > {_m.ucl_spe} AS anomaly FROM stat)"
)
RANGES_SQL = "ranges AS (SELECT *, start_ts IS NOT NULL AND end_ts IS NOT NULL AS valid FROM (SELECT *, try_cast(replace(start_time, 'T', ' ') AS TIMESTAMP) AS start_ts, try_cast(replace(end_time, 'T', ' ') AS TIMESTAMP) AS end_ts FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, a, b in RANGES) + ") v(range_id, start_time, end_time)))"
STRIP = "regexp_replace({0}, '^[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g')"


def semantic(text: str, most: int = 800, least: int = 100) -> str:
    """The semantic chunks of a text: a fold over paragraphs, and in it one over sentences; the state is the closed chunks and the open one."""
    blank, none, nothing = r"[\s\x1c-\x1f\x{85}\p{Z}]", "[]::VARCHAR[]", "''::VARCHAR"
    state = "{{'closed': {0}, 'open': {1}}}".format
    joined = "CASE WHEN {0} <> '' AND {1} <> '' THEN {0} || chr(10) || chr(10) || {1} ELSE {0} || {1} END".format
    fold = lambda items, step: f"list_reduce(list_transform({items}, lambda item: {state(none, 'item')}), lambda a, p: {step}, {state(none, nothing)})"
    with_ = lambda value, name, then: f"list_transform([{value}], lambda {name}: {then})[1]"
    sentences = f"list_filter(regexp_extract_all(n.open, '[^。！？.!?]*[。！？.!?]+{blank}*|[^。！？.!?]+'), lambda s: {STRIP.format('s')} <> '')"
    add = f"CASE WHEN length(a.open) + length(p.open) <= {most} THEN {state('a.closed', 'a.open || p.open')} ELSE {state('list_append(a.closed, a.open)', 'p.open')} END"
    pieces = f"list_concat(n.closed, list_filter(list_transform(v.closed, lambda c: {STRIP.format('c')}), lambda c: c <> ''))"
    cut = with_(fold(sentences, add), "v", state(pieces, "v.open"))
    next_ = f"CASE WHEN length(a.open) >= {least} THEN {state('list_append(a.closed, a.open)', 'p.open')} ELSE {state('a.closed', joined('a.open', 'p.open'))} END"
    grown = with_(next_, "n", f"CASE WHEN length(n.open) > {most} THEN {cut} ELSE n END")
    step = f"CASE WHEN length(a.open) + length(p.open) + 2 <= {most} THEN {state('a.closed', joined('a.open', 'p.open'))} ELSE {grown} END"
    paragraphs = f"list_filter(list_transform(regexp_split_to_array({text}, '\\n{blank}*\\n'), lambda q: {STRIP.format('q')}), lambda q: q <> '')"
    back = f"list_append(f.closed[:len(f.closed) - 1], {joined('f.closed[len(f.closed)]', 'f.open')})"
    return with_(fold(paragraphs, step), "f", f"CASE WHEN len(f.closed) > 0 AND length(f.open) < {least} THEN {back} ELSE list_filter(list_append(f.closed, f.open), lambda c: c <> '') END")


DOCS = "docs AS (SELECT doc_id, source AS source_file, source || '/' || doc_id AS file_path, text FROM documents)"
CHUNKS = (
    DOCS
    + f", cut AS (SELECT doc_id, source_file, file_path, list_filter(list_transform(range(0, length(text), {CHUNK['size'] - CHUNK['overlap']}), lambda s: {STRIP.format(f'substr(text, s + 1, {CHUNK["size"]})')}), lambda c: c <> '') AS pieces FROM docs)"
    + ", chunks AS (SELECT doc_id, source_file, file_path, doc_id * 100000 + pos AS chunk_id, pos AS chunk_pos, pieces[pos + 1] AS text FROM (SELECT *, unnest(range(0, len(pieces))) AS pos FROM cut))"
)
QUERIES = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL VALUES (1000001, 'qqzzqq xxyyxx'), (1000002, chr(32) || chr(32) || chr(10) || chr(32)))"
TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def terms(source: str, key: str, text: str, name: str) -> str:
    """CTEs: token lists, and counts of terms as ``name``."""
    return f"{name}_tok AS (SELECT {key}, {TOKENS.format(text)} AS tok FROM {source}), {name} AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(list_concat(tok, list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]))) AS term FROM {name}_tok) GROUP BY ALL)"


def fitted(counts: str, source: str, k: int = 1000) -> str:
    return f"vocab AS (SELECT term, sum(tf) AS total, count(*) AS df, ln((1 + (SELECT count(*) FROM {source})::DOUBLE) / (1 + count(*))) + 1 AS idf FROM {counts} GROUP BY term ORDER BY total DESC, term LIMIT {k})"


def weighed(counts: str, key: str, name: str) -> str:
    return f"{name}_w AS (SELECT {key}, c.term, tf * idf AS w FROM {counts} c JOIN vocab USING (term)), {name} AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM {name}_w)"


INDEX = CHUNKS + ", " + terms("chunks", "chunk_id", "text", "counts") + ", " + fitted("counts", "chunks") + ", " + weighed("counts", "chunk_id", "vectors")
EMBEDDED = INDEX + ", " + QUERIES + ", asked AS (SELECT * FROM queries WHERE " + STRIP.format("query") + " <> ''), " + terms("asked", "query_id", "query", "qcounts") + ", " + weighed("qcounts", "query_id", "qvec")
KNOWLEDGE = (
    "features AS (SELECT 'feature' || (p_partkey + 1) AS feature_name, p_name AS name, p_type AS description, 'u' || p_size AS unit, '0-1' AS normal_range, p_brand AS related_to, string_split(p_name, ' ') AS anomaly_causes, p_type AS impact FROM part)"
    ", said AS (SELECT conv_id AS solution_id, coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'user'), []) AS u, coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'system'), []) AS root_causes, coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'assistant'), []) AS solutions FROM conversations GROUP BY conv_id)"
    ", solutions AS (SELECT solution_id, coalesce(u[1], '') AS problem, u[2:] AS symptoms, root_causes, solutions, ['critical', 'high', 'medium', 'low'][solution_id % 4 + 1] AS priority FROM said)"
    ", concepts AS (SELECT item_id AS concept_id, string_split(text, ' ')[1] AS term, text AS definition, '' AS interpretation, 'c' || (item_id % 3) AS category FROM benchmark)"
)
_list = "coalesce(array_to_string({0}, ', '), '')".format
KB = (
    KNOWLEDGE
    + f", kb AS (SELECT 'feature:' || feature_name AS kb_id, 'feature' AS type, feature_name AS key, NULL AS priority, feature_name || ' ' || name || '. ' || description || ' 相关系统: ' || related_to || '. 可能异常原因: ' || {_list('anomaly_causes')} || '. 影响: ' || impact AS text FROM features"
    + f" UNION ALL SELECT 'solution:' || lpad(solution_id::VARCHAR, 12, '0'), 'solution', problem, priority, '问题: ' || problem || '. 症状: ' || {_list('symptoms')} || '. 根本原因: ' || {_list('root_causes')} || '. 解决方案: ' || {_list('solutions')} FROM solutions"
    + " UNION ALL SELECT 'concept:' || lpad(concept_id::VARCHAR, 12, '0'), 'concept', term, NULL, term || ': ' || definition || '. ' || interpretation FROM concepts)"
)
KB_INDEX = KB + ", " + terms("kb", "kb_id", "text", "counts") + ", " + fitted("counts", "kb") + ", " + weighed("counts", "kb_id", "vectors")


def cosine_search(asked: str, k: int, only: str = "true") -> str:
    """CTE hits(query_id, rank, kb_id, score) over a CTE ``asked``(query_id, query) already defined, prefixed by KB_INDEX."""
    return terms(asked, "query_id", "query", "qcounts") + ", " + weighed("qcounts", "query_id", "qvec") + (
        ", dots AS (SELECT query_id, kb_id, sum(q.weight * v.weight) AS dot FROM qvec q JOIN vectors v USING (term) GROUP BY ALL)"
        f", hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kb_id) AS rank, kb_id, score FROM (SELECT a.query_id, k.kb_id, coalesce(round(dot / ((1 + 1e-10) * (1 + 1e-10)), 9), 0) AS score FROM {asked} a CROSS JOIN (SELECT * FROM kb WHERE {only}) k LEFT JOIN dots d ON d.query_id = a.query_id AND d.kb_id = k.kb_id) QUALIFY rank <= {k})"
    )
