"""Retrieval strategies. Each is a function of DataFrames; a hit has id, score and strategy.

Top-k is an ordered limit, which Spark takes per partition first; only k rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexlake.functions.vectors import METRICS
from lexlake.operators.blocks import nearest


def vector_hits(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", id_: str = "id", vector: str = "embedding") -> DataFrame:
    """The k vectors nearest to a query, exactly; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = METRICS[metric](F.col(vector), q)
    order = F.col("score").asc() if metric == "euclidean" else F.col("score").desc_nulls_last()
    return vectors.select(F.col(id_).alias("id"), score.alias("score")).orderBy(order, "id").limit(k).withColumn("strategy", F.lit("vector"))


def many_queries(vectors: DataFrame, queries: DataFrame, k: int, id_: str = "id", vector: str = "embedding") -> DataFrame:
    """query_no, id, score, rank: the k nearest of each query, exactly, by block products; either side may exceed a task's memory."""
    key = F.lit(0).alias("key")
    return nearest(queries.select(key, "query_no", "vector"), vectors.select(key, F.col(id_).alias("id"), F.col(vector).alias("vector")), k)


def position_scored(rows: DataFrame, k: int, order: str = "id") -> DataFrame:
    """The first k rows with the score 1 - place / n."""
    top = rows.orderBy(order).limit(k)
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1
    return top.withColumn("score", 1.0 - place / n)


def keyword_hits(docs: DataFrame, words: str, k: int, text: str = "text", name: str | None = None, id_: str = "doc_id") -> DataFrame:
    """Documents whose text or name holds a string, case ignored, by id; scored by place."""
    found = F.contains(F.lower(text), F.lit(words.lower()))
    if name:
        found = found | F.contains(F.lower(name), F.lit(words.lower()))
    return position_scored(docs.filter(found).select(F.col(id_).alias("id")), k).withColumn("strategy", F.lit("keyword"))


def path_hits(docs: DataFrame, pattern: str, k: int, path: str, scope: str | None = None, scope_column: str = "source", id_: str = "doc_id") -> DataFrame:
    """Documents whose path holds a string, case and all, perhaps of one law only; scored by place."""
    rows = docs.filter(F.contains(F.col(path), F.lit(pattern)))
    if scope is not None:
        rows = rows.filter(F.col(scope_column) == scope)
    return position_scored(rows.select(F.col(id_).alias("id")), k).withColumn("strategy", F.lit("graph"))


def hybrid(vector: DataFrame, keyword: DataFrame, k: int, vector_weight: float = 0.7) -> DataFrame:
    """Both lists by id: the weighted sum of scores, a missing one counting 0."""
    both = vector.select("id", F.col("score").alias("vector_score")).join(keyword.select("id", F.col("score").alias("keyword_score")), "id", "full")
    both = both.fillna(0.0, ["vector_score", "keyword_score"])
    score = F.col("vector_score") * vector_weight + F.col("keyword_score") * (1.0 - vector_weight)
    return both.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k).withColumn("strategy", F.lit("hybrid"))


def over_fetch(k: int, factor: int = 2, most: int = 50) -> int:
    """How many hits a list hands to a merge that keeps k."""
    return min(k * factor, most)


def merged_max(lists: list[DataFrame], k: int) -> DataFrame:
    """Several hit lists as one: of an id the best score, the k best."""
    union = reduce(DataFrame.unionByName, [x.select("id", "score") for x in lists])
    return union.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key, in the order given."""
    columns = [c for c in rows.columns if c != key]
    best = F.min_by(F.struct(*columns), F.struct(*order)).alias("_b")
    return rows.groupBy(key).agg(best).select(key, *[F.col(f"_b.{c}") for c in columns])


def reranked(hits: DataFrame, degree: DataFrame, k: int, weight: float, most: int = 20) -> DataFrame:
    """Hits by score plus a weighted, capped number of references; only the hits' own references are counted."""
    near = degree.join(F.broadcast(hits.select("id")), "id", "left_semi")
    rows = hits.join(near, "id", "left").withColumn("degree", F.least(F.coalesce("degree", F.lit(0)), F.lit(most)))
    return rows.withColumn("score", F.col("score") + F.col("degree") * weight).orderBy(F.desc("score"), "id").limit(k)


def filtered(hits: DataFrame, min_score: float | None = None, sources: list[str] | None = None, as_of=None) -> DataFrame:
    """Hits of at least a score, of some laws, in force at a date (columns score, source, valid_to)."""
    if min_score is not None:
        hits = hits.filter(F.col("score") >= min_score)
    if sources is not None:
        hits = hits.filter(F.col("source").isin(sources))
    if as_of is not None:
        hits = hits.filter(F.col("valid_to").isNull() | (F.col("valid_to") > as_of))
    return hits


def nearest_phrase(queries: DataFrame, phrases: DataFrame, least: float = 0.5, categories: list[str] | None = None) -> DataFrame:
    """query_no, phrase, category, similarity of the nearest phrase (a number; of equally near ones the greatest), perhaps of some categories only,
    if near enough."""
    if categories is not None:
        phrases = phrases.filter(F.col("category").isin(categories))
    key = F.lit(0).alias("key")
    best = nearest(queries.select(key, "query_no", "vector"), phrases.select(key, F.col("phrase").alias("id"), F.col("phrase_vector").alias("vector")), 1, last_id=True)
    best = best.filter(F.col("score") >= least).select("query_no", F.col("id").alias("phrase"), F.col("score").alias("similarity"))
    return best.join(phrases.select(F.col("phrase").cast("long").alias("phrase"), "category"), "phrase").select("query_no", "phrase", "category", "similarity")


def with_texts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits with rich_text, fetched again by id (``texts``: id, rich_text); a hit without one keeps a null."""
    return hits.join(texts.select("id", "rich_text"), "id", "left")


#: Modes of the graph strategy.
GRAPH_MODES = ("structure", "versions", "subject")


def graph_hits(docs: DataFrame, mode: str, asked: str, k: int, path: str = "path", chain: str = "chain", order: str = "version_no", subject: str = "subject", id_: str = "doc_id") -> DataFrame:
    """Hits of the graph strategy: by path (scored by place), all versions of a chain (the later the higher) or a subject's (by place); an unknown mode finds
    nothing."""
    if mode == "structure":
        return path_hits(docs, asked, k, path, id_=id_)
    if mode == "versions":
        found = docs.filter(F.col(chain).cast("string") == asked).select(F.col(id_).alias("id"), F.col(order).alias("_o"))
        every = Window.partitionBy(F.lit(0))
        found = found.withColumn("score", F.row_number().over(every.orderBy("_o", "id")) / F.count("*").over(every))
        return found.orderBy(F.desc("score"), "id").limit(k).select("id", "score", F.lit("graph").alias("strategy"))
    rows = docs.filter(F.col(subject).cast("string") == asked) if mode == "subject" else docs.limit(0)
    return position_scored(rows.select(F.col(id_).alias("id")), k).withColumn("strategy", F.lit("graph"))


def searched(strategies: dict[str, Callable[[], DataFrame]], names: list[str]) -> dict[str, DataFrame | Exception]:
    """The hits of several strategies by name. One that isn't known is a ValueError before any runs; one that fails gives its error in place of hits, the
    others are not touched (``hits_or_none`` makes it an empty list)."""
    unknown = [n for n in names if n not in strategies]
    if unknown:
        raise ValueError(f"no strategy of the name {unknown[0]!r}; there are {sorted(strategies)}")
    out: dict[str, DataFrame | Exception] = {}
    for name in names:
        try:
            hits = strategies[name]()
            _ = hits.schema
            out[name] = hits
        except Exception as e:  # whatever a strategy raises is its own failure
            out[name] = e
    return out


def hits_or_none(spark: SparkSession, found: dict[str, DataFrame | Exception]) -> DataFrame:
    """strategy, id, score of all strategies that ``searched`` could run; failed ones have no rows."""
    rows = [x.select(F.lit(n).alias("strategy"), "id", F.col("score").cast("double").alias("score")) for n, x in found.items() if isinstance(x, DataFrame)]
    return reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], "strategy string, id long, score double")


def checked_requests(requests: DataFrame, most: int = 100) -> DataFrame:
    """``requests`` with query trimmed and error: why a request is refused, null if it isn't. A null query is an empty
    one; top_k must be from 1 to ``most``."""
    rows = requests.withColumn("query", F.btrim(F.coalesce("query", F.lit("")), F.lit(" \t\r\n")))
    return rows.withColumn("error", F.when(F.col("query") == "", "empty query").when(~F.coalesce(F.col("top_k").between(1, most), F.lit(False)), "top_k out of range"))
