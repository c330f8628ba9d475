"""The typed knowledge base: lookups, documents, search and recommendations.

Knowledge tables may grow like any other: joins with them are plain, and adaptive execution broadcasts what turns out small.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.search import blank_query_guard, search_cosine, search_tfidf_l2
from plumbline.operators.tfidf import build_index
from plumbline.sources.shared import materialize

# Words and templates of the knowledge documents and queries.
LABELS = {"related": "相关系统", "causes": "可能异常原因", "impact": "影响", "problem": "问题", "symptoms": "症状", "root_causes": "根本原因", "solutions": "解决方案"}
UNKNOWN, NOT_RECORDED, ABNORMAL = "未知", "该特征的物理含义暂未录入知识库", "异常"
DETECTED, T2_QUERY, SPE_QUERY = "异常检测", "T2统计量 异常", "SPE统计量 异常"
FOUND = "检测到异常，主要涉及特征: "
#: Words of an automaton; some 100 MB a worker.
KEYWORD_BLOCK = 100_000
FIELDS = ("name", "description", "unit", "normal_range", "related_to", "anomaly_causes", "impact")


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _or(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _list(c: str) -> Column:
    return F.coalesce(F.array_join(c, ", "), F.lit(""))


def kb_documents(features: DataFrame, solutions: DataFrame, concepts: DataFrame, labels: dict[str, str] = LABELS) -> DataFrame:
    """One table of documents: kb_id (type and key), type, key, priority or category, text."""
    la = labels
    f = features.select(_text("feature:", F.col("feature_name")).alias("kb_id"), F.lit("feature").alias("type"), F.col("feature_name").alias("key"), F.lit(None).cast("string").alias("priority"), _text(F.col("feature_name"), " ", _or("name"), ". ", _or("description"), f" {la['related']}: ", _or("related_to"), f". {la['causes']}: ", _list("anomaly_causes"), f". {la['impact']}: ", _or("impact")).alias("text"))
    s = solutions.select(_text("solution:", F.lpad(F.col("solution_id").cast("string"), 12, "0")).alias("kb_id"), F.lit("solution").alias("type"), _or("problem").alias("key"), F.coalesce("priority", F.lit("medium")).alias("priority"), _text(f"{la['problem']}: ", _or("problem"), f". {la['symptoms']}: ", _list("symptoms"), f". {la['root_causes']}: ", _list("root_causes"), f". {la['solutions']}: ", _list("solutions")).alias("text"))
    c = concepts.select(_text("concept:", F.lpad(F.col("concept_id").cast("string"), 12, "0")).alias("kb_id"), F.lit("concept").alias("type"), _or("term").alias("key"), F.lit(None).cast("string").alias("priority"), _text(_or("term"), ": ", _or("definition"), ". ", _or("interpretation")).alias("text"))
    return f.unionByName(s).unionByName(c)


def build_kb_index(kb: DataFrame) -> dict[str, DataFrame]:
    """TF-IDF over the documents of all types together."""
    return build_index(kb, key="kb_id")


def lookup_features(names: DataFrame, features: DataFrame) -> DataFrame:
    """Known names with their information."""
    return names.join(features, "feature_name")


def explain_features(names: DataFrame, features: DataFrame) -> DataFrame:
    """Seven fields a name; unknown names keep their own as name, with a default description."""
    known = features.withColumn("__known", F.lit(True))
    out = names.join(known, "feature_name", "left")
    new = F.col("__known").isNull()
    default = {"name": F.when(new, F.col("feature_name")).otherwise(F.lit(UNKNOWN)), "description": F.when(new, NOT_RECORDED).otherwise("")}
    fields = [(F.coalesce(F.col(c), default.get(c, F.array().cast("array<string>") if c == "anomaly_causes" else F.lit(""))).alias(c)) for c in FIELDS]
    return out.select(*names.columns, *fields)


def solutions_by_priority(solutions: DataFrame, priority: str) -> DataFrame:
    return solutions.filter(F.col("priority") == priority)


def _haystack() -> Column:
    return F.lower(_text(_or("problem"), " ", F.coalesce(F.array_join("symptoms", " "), F.lit("")), " ", F.coalesce(F.array_join("root_causes", " "), F.lit(""))))


class Keywords:
    """One automaton for many words: a text is read once, however many there are. It is built where it is first used."""

    def __init__(self, words: list[str]) -> None:
        self.words, self.automaton = words, None

    def __getstate__(self) -> dict:
        return {"words": self.words, "automaton": None}

    def first_in(self, text: str) -> bool:
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for w in self.words:
                self.automaton.add_word(w)
            self.automaton.make_automaton()
        return next(self.automaton.iter(text), None) is not None


def _with_any(texts: DataFrame, words: list[str]) -> DataFrame:
    """(solution_id, __hay) -> the ids of texts that hold a word; in one pass."""
    shared, kind = texts.sparkSession.sparkContext.broadcast(Keywords(words)), texts.schema["solution_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = pa.array([shared.value.first_in(t) for t in b.column("__hay").to_pylist()], type=pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("solution_id").filter(hit)], names=["solution_id"])

    return texts.select("solution_id", "__hay").mapInArrow(run, T.StructType([T.StructField("solution_id", kind)]))


def solutions_by_keyword(solutions: DataFrame, keywords: list[str] | DataFrame, block: int | None = None) -> DataFrame:
    """Solutions that hold any keyword, in any case; each once. A DataFrame has the column keyword; null ones are no keywords.

    Keywords of a table make an automaton (Aho and Corasick 1975) a block of ``block`` (``KEYWORD_BLOCK``) at most, so a text is read once a block,
    and what is broadcast is a block. An empty keyword is in every text.
    """
    if not isinstance(keywords, DataFrame):
        return solutions.filter(F.exists(F.array(*(F.lit(k.lower()) for k in keywords)).cast("array<string>"), lambda k: F.contains(_haystack(), k)))
    words = materialize(keywords.select(F.lower("keyword").alias("k")).filter("k is not null").distinct(), "keywords")
    if words.filter("k = ''").limit(1).count():
        return solutions
    hay, found = solutions.select("solution_id", _haystack().alias("__hay")), None
    for held in _blocks(words, block or KEYWORD_BLOCK):
        one = _with_any(hay, held)
        found = one if found is None else found.union(one)
    return solutions.limit(0) if found is None else solutions.join(found.distinct(), "solution_id", "left_semi")


def _blocks(words: DataFrame, block: int) -> Iterator[list[str]]:
    """The words in lists of ``block`` at most, by hash; a list that comes out too long is cut."""
    parts = max(1, -(-words.count() // max(1, block * 3 // 4)))
    for i in range(parts):
        held = [r["k"] for r in words.filter(F.pmod(F.xxhash64("k"), F.lit(parts)) == i).toLocalIterator()]
        yield from (held[at : at + block] for at in range(0, len(held), block))


def concept_by_term(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """(term_query) -> the first concept of that term, in any case."""
    met = queries.join(concepts, F.lower("term") == F.lower("term_query"))
    return met.groupBy("term_query").agg(F.min_by(F.struct(*concepts.columns), "concept_id").alias("c")).select("term_query", "c.*")


def kb_stats(kb: dict[str, DataFrame]) -> DataFrame:
    """One row of counts."""
    out = None
    for name, df in kb.items():
        one = df.agg(F.count(F.lit(1)).alias(f"{name}_count"))
        out = one if out is None else out.join(one)
    return out


def search_typed(queries: DataFrame, index: dict[str, DataFrame], kind: str | None, k: int) -> DataFrame:
    only = None if kind is None else F.col("type") == kind
    return search_cosine(queries, index, k, "kb_id", only)


def search_concepts(queries: DataFrame, index: dict[str, DataFrame], k: int = 3) -> DataFrame:
    return search_typed(queries, index, "concept", k)


def solution_queries(problems: DataFrame, features: DataFrame) -> DataFrame:
    """(query_id, problem, feature_names) -> (query_id, query): the problem, then name and related_to of its known features."""
    each = problems.select("query_id", F.posexplode_outer("feature_names").alias("at", "feature_name"))
    info = each.join(features.select("feature_name", "name", "related_to"), "feature_name")
    more = info.groupBy("query_id").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", F.array(_or("name"), _or("related_to")).alias("w")))), lambda x: x["w"])), " ").alias("more"))
    return problems.join(more, "query_id", "left").select("query_id", F.concat_ws(" ", "problem", "more").alias("query"))


def find_solutions(problems: DataFrame, features: DataFrame, index: dict[str, DataFrame], k: int = 3) -> DataFrame:
    """query_id, rank, kb_id, score of the nearest solutions."""
    return search_typed(solution_queries(problems, features), index, "solution", k)


def with_solutions(hits: DataFrame, solutions: DataFrame) -> DataFrame:
    """Hits of find_solutions with the solution's seven fields, score as relevance_score."""
    own = solutions.withColumn("kb_id", _text("solution:", F.lpad(F.col("solution_id").cast("string"), 12, "0")))
    return own.join(hits, "kb_id").withColumnRenamed("score", "relevance_score")


def explain_with_solutions(names: DataFrame, features: DataFrame, solutions: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """(query_id, feature_names) -> two solutions of "a, b abnormal", three fixes each."""
    problems = names.withColumn("problem", _text(F.array_join("feature_names", ", "), f" {ABNORMAL}"))
    hits = with_solutions(find_solutions(problems, features, index, 2), solutions)
    return hits.select("query_id", "rank", "problem", F.slice("solutions", 1, 3).alias("solutions"), "priority")


def related_features(names: DataFrame, features: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """(query_id, feature_names) -> of the three nearest features those that were not asked for."""
    each = names.select("query_id", F.posexplode("feature_names").alias("at", "feature_name")).join(features.select("feature_name", "name"), "feature_name")
    q = each.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("name", "feature_name").alias("n")))), lambda x: x["n"]), " ").alias("query"))
    hits = search_typed(blank_query_guard(q), index, "feature", 3).withColumn("feature_name", F.substring_index("kb_id", ":", -1))
    return hits.join(names.select("query_id", F.explode("feature_names").alias("feature_name")), ["query_id", "feature_name"], "left_anti").select("query_id", "rank", "feature_name", "score")


def search_knowledge(queries: DataFrame, kb_index: dict[str, DataFrame], chunk_index: dict[str, DataFrame] | None = None, k: int = 3, kind: str | None = None) -> DataFrame:
    """One shape for both: the chunk index where there is one (kind is ignored then), else the typed knowledge base."""
    if chunk_index is not None:
        hits = search_tfidf_l2(queries, chunk_index, k)
        return hits.select("query_id", "rank", F.col("chunk_id").cast("string").alias("hit"), "score", F.lit("chunks").alias("source"))
    return search_typed(blank_query_guard(queries), kb_index, kind, k).select("query_id", "rank", F.col("kb_id").alias("hit"), "score", F.lit("knowledge").alias("source"))


def anomaly_feature_set(t2_top: str = "t2_top", spe_top: str = "spe_top", most: int = 5) -> Column:
    """Distinct features of both lists, T2 first, at most five."""
    names = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<feature:string,value:double>>")), lambda x: x["feature"])
    return F.slice(F.array_distinct(F.concat(names(t2_top), names(spe_top))), 1, most)


CONCEPT_FIELDS = ("term", "definition", "interpretation", "category")
SOLUTION_FIELDS = ("problem", "symptoms", "root_causes", "solutions", "priority", "typical_resolution_time")


def recommend(anomalies: DataFrame, features: DataFrame, index: dict[str, DataFrame], kb: dict[str, DataFrame] | None = None) -> DataFrame:
    """(anomaly_id, t2_anomaly, spe_anomaly, t2_top, spe_top) -> explained features, solutions, concepts and a summary.

    Anomalies share few distinct feature sets: each set is searched once, and joined back. Given the tables of ``kb`` the
    result has them in full, too: ``explanations`` (a feature's name and seven fields, known features only), ``found_solutions``
    (three at most, six fields and relevance_score, best first) and ``found_concepts`` (two at most, for T2 and for SPE).
    """
    a = anomalies.withColumn("feature_names", anomaly_feature_set())
    sets = a.select("feature_names").distinct().filter(F.size("feature_names") > 0).withColumn("query_id", F.xxhash64("feature_names"))
    listed = F.array_join("feature_names", ", ")
    hits = find_solutions(sets.withColumn("problem", _text(f"{DETECTED} ", listed, f" {ABNORMAL}")), features, index, 3)
    ordered = lambda df, at, **parts: df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(at, *(v.alias(n) for n, v in parts.items())))).alias("__all")).select("query_id", *(F.col("__all")[n].alias(n) for n in parts))
    each = sets.select("query_id", F.posexplode("feature_names").alias("at", "feature_name")).join(features, "feature_name")
    line = _text(F.col("feature_name"), "(", _or("name"), "): ", _or("impact"))
    spark = anomalies.sparkSession
    fixed = search_concepts(spark.createDataFrame([(1, T2_QUERY), (2, SPE_QUERY)], "query_id long, query string"), index, 1)
    which = lambda n, c: F.max(F.when(F.col("query_id") == n, c)).alias(f"c{n}")
    if kb is None:
        sols = ordered(hits, "rank", solutions=F.col("kb_id"))
        info = ordered(each, "at", explained=F.col("feature_name"), lines=line)
        concept, more = fixed.agg(*(which(n, F.struct("kb_id")) for n in (1, 2))), []
    else:
        default = {"name": F.lit(UNKNOWN), "anomaly_causes": F.array().cast("array<string>")}
        field = lambda c: F.coalesce(F.col(c), default.get(c, F.lit(""))).alias(c)
        sols = ordered(with_solutions(hits, kb["solutions"]), "rank", solutions=F.col("kb_id"), found_solutions=F.struct(*SOLUTION_FIELDS, "relevance_score"))
        info = ordered(each, "at", explained=F.col("feature_name"), lines=line, explanations=F.struct("feature_name", *map(field, FIELDS)))
        own = kb["concepts"].withColumn("kb_id", _text("concept:", F.lpad(F.col("concept_id").cast("string"), 12, "0")))
        told = own.join(fixed.withColumnRenamed("score", "relevance_score"), "kb_id")
        concept = told.agg(*(which(n, F.struct("kb_id", F.struct(*CONCEPT_FIELDS, "relevance_score").alias("found"))) for n in (1, 2)))
        empty = lambda c: F.array().cast(out.schema[c].dataType)
        more = [lambda: F.coalesce("explanations", empty("explanations")).alias("explanations"), lambda: F.coalesce("found_solutions", empty("found_solutions")).alias("found_solutions"), lambda: chosen("found").alias("found_concepts")]
    # written: a table of sets is small and broadcast, or a plain side of a join whose hot sets adaptive execution splits
    made = materialize(sets.join(sols, "query_id", "left").join(info, "query_id", "left").drop("feature_names"), "recommended")
    out = a.withColumn("query_id", F.xxhash64("feature_names")).join(made, "query_id", "left").join(F.broadcast(concept))  # one row
    some, none = F.size("feature_names") > 0, F.array().cast("array<string>")

    def chosen(part: str) -> Column:
        """A part of the concepts that the anomaly's statistics ask for."""
        picked = F.filter(F.array(F.when(some & F.col("t2_anomaly"), F.col("c1")), F.when(some & F.col("spe_anomaly"), F.col("c2"))), lambda c: c.isNotNull())
        return F.transform(picked, lambda c: c[part])

    lines = F.array_join(F.slice("lines", 1, 2), " ")
    summary = F.when(some, _text(FOUND, listed, "。", F.coalesce(lines, F.lit("")))).otherwise("")
    base = ["anomaly_id", "feature_names", F.coalesce("explained", none).alias("explained"), F.coalesce("solutions", none).alias("solutions"), chosen("kb_id").alias("concepts"), (F.size(F.coalesce("solutions", none)) > 0).alias("has_recommendations"), summary.alias("summary")]
    return out.select(*base, *(c() for c in more))
