"""Queries that search documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexlake.functions.vectors import METRICS, cosine
from lexlake.operators import evaluation, vector_index
from lexlake.operators import retrieval as ops
from lexlake.plans.catalogue import query, table
from lexlake.session import scratch

WORD = "onth"
_COS = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))"
_KEY = f"k AS (SELECT id, 1.0 - (row_number() OVER (ORDER BY id) - 1)::DOUBLE / count(*) OVER () AS score FROM (SELECT doc_id AS id FROM documents WHERE contains(lower(text), '{WORD}') ORDER BY id LIMIT %d))"
_VEC = f"v AS (SELECT e.vec_id AS id, {_COS} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 7) q ORDER BY round(score, 9) DESC, id LIMIT %d)"
_DEGREE = "d AS (SELECT l_orderkey AS id, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY 1)"


def _vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []


def _vector_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return ops.vector_hits(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), k, id_="vec_id")


def _keyword_hits(spark: SparkSession, sf_dir: str, k: int, word: str = WORD) -> DataFrame:
    return ops.keyword_hits(table(spark, sf_dir, "documents"), word, k)


def _degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.countDistinct("l_partkey").alias("degree"))


@query(f"WITH {_KEY % 10} SELECT id, round(score, 6) AS score FROM k")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten documents with a string, scored by place."""
    return _keyword_hits(spark, sf_dir, 10).select("id", F.round("score", 6).alias("score"))


@query("SELECT doc_id AS id, round(1.0 - (row_number() OVER (ORDER BY doc_id) - 1)::DOUBLE / count(*) OVER (), 6) AS score FROM (SELECT doc_id FROM documents WHERE contains(lang || '/' || source, 'fr/src1') AND source = 'src1' ORDER BY doc_id LIMIT 20)")
def path_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source whose path holds a string."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "lang", "source"))
    return ops.path_hits(docs, "fr/src1", 20, "path", "src1").select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC % 10} SELECT id, round(score, 6) AS score, round((1 + score) / 2, 6) AS unit_score FROM v")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors of least angle to a query."""
    return _vector_hits(spark, sf_dir, 10).select("id", F.round("score", 6).alias("score"), F.round((1 + F.col("score")) / 2, 6).alias("unit_score"))


@query(f"""SELECT e.vec_id AS id, round({_COS}, 6) AS cosine, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dot,
  round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS euclidean FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 7) q""")
def vector_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three measures of every vector against a query."""
    q = F.array(*[F.lit(float(x)) for x in _vector(spark, sf_dir)])
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[F.round(m(F.col("embedding"), q), 6).alias(n) for n, m in METRICS.items()])


@query(f"""SELECT query_no, id, rank FROM (SELECT q.vec_id AS query_no, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, e.vec_id) AS rank
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 5""")
def multi_query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector, in one plan."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_no"), F.col("embedding").alias("vector"))
    return ops.many_queries(vectors, queries, 5, id_="vec_id").select("query_no", "id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT label, id FROM (SELECT e.label, e.vec_id AS id, row_number() OVER (PARTITION BY e.label ORDER BY round(""" + _COS + """, 9) DESC, e.vec_id) AS rn
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 7) q) WHERE rn <= 3""")
def knn_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of every label."""
    q = F.array(*[F.lit(float(x)) for x in _vector(spark, sf_dir)])
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("id"), F.round(cosine(F.col("embedding"), q), 9).alias("score"))
    order = Window.partitionBy("label").orderBy(F.desc("score"), "id")
    return rows.withColumn("rn", F.row_number().over(order)).filter("rn <= 3").select("label", "id")


@query(f"""SELECT query_no, phrase, round(s, 6) AS similarity FROM (SELECT q.vec_id AS query_no, e.vec_id AS phrase, {_COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, e.vec_id DESC) AS rn
  FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) e, embeddings q) WHERE rn = 1 AND s >= 0.3""")
def classify_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest phrase, if it is near enough (the first vector of every label stands in for a phrase)."""
    vectors = table(spark, sf_dir, "embeddings")
    first = F.min_by(F.struct(F.col("vec_id").alias("phrase"), F.col("label").alias("category"), F.col("embedding").alias("phrase_vector")), "vec_id")
    phrases = vectors.groupBy("label").agg(first.alias("p")).select("p.*")
    queries = vectors.select(F.col("vec_id").alias("query_no"), F.col("embedding").alias("vector"))
    return ops.nearest_phrase(queries, phrases, 0.3).select("query_no", "phrase", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_VEC % 20}, {_KEY % 20}, m AS (SELECT coalesce(v.id, k.id) AS id, coalesce(v.score, 0) AS vs, coalesce(k.score, 0) AS ks FROM v FULL JOIN k ON v.id = k.id)
  SELECT id, round(vs, 6) AS vector_score, round(ks, 6) AS keyword_score, round(vs * 0.7 + ks * (1.0 - 0.7), 6) AS score FROM m ORDER BY vs * 0.7 + ks * (1.0 - 0.7) DESC, id LIMIT 10""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and keyword hits merged by weight."""
    n = ops.over_fetch(10)
    rows = ops.hybrid(_vector_hits(spark, sf_dir, n), _keyword_hits(spark, sf_dir, n), 10)
    return rows.select("id", *[F.round(c, 6).alias(c) for c in ("vector_score", "keyword_score", "score")])


@query(f"WITH {_VEC % 20}, {_DEGREE} SELECT v.id, least(coalesce(degree, 0), 20) AS degree, round(score + 0.05 * least(coalesce(degree, 0), 20), 6) AS score FROM v LEFT JOIN d ON v.id = d.id ORDER BY score + 0.05 * least(coalesce(degree, 0), 20) DESC, v.id LIMIT 10")
def connectivity_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits again by score and number of references."""
    return ops.reranked(_vector_hits(spark, sf_dir, 20), _degree(spark, sf_dir), 10, 0.05).select("id", F.col("degree").cast("long").alias("degree"), F.round("score", 6).alias("score"))


@query(f"""WITH {_DEGREE}, w AS (SELECT doc_id AS id FROM (SELECT doc_id FROM documents WHERE contains(lower(text), 'onth') ORDER BY doc_id LIMIT 10) UNION ALL SELECT doc_id FROM (SELECT doc_id FROM documents WHERE contains(lower(text), 'ción') ORDER BY doc_id LIMIT 10)
  UNION ALL SELECT doc_id FROM (SELECT doc_id FROM documents WHERE contains(lower(text), 'er') ORDER BY doc_id LIMIT 10)), m AS (SELECT id, count(*) AS matches FROM w GROUP BY id)
  SELECT m.id, matches, round(matches + 0.1::DOUBLE * least(coalesce(degree, 0), 20), 6) AS score FROM m LEFT JOIN d ON m.id = d.id ORDER BY 3 DESC, 1 LIMIT 10""")
def keyword_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the number of words they match and of their references."""
    lists = [_keyword_hits(spark, sf_dir, 10, w).select("id") for w in ("onth", "ción", "er")]
    found = lists[0].unionByName(lists[1]).unionByName(lists[2]).groupBy("id").agg(F.count("*").alias("matches"))
    rows = ops.reranked(found.withColumn("score", F.col("matches").cast("double")), _degree(spark, sf_dir), 10, 0.1)
    return rows.select("id", "matches", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC % 30}, {_KEY % 30}, u AS (SELECT id, score FROM v UNION ALL SELECT id, score FROM k) SELECT id, round(max(score), 6) AS score FROM u GROUP BY id ORDER BY max(score) DESC, id LIMIT 15")
def multi_query_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hit lists as one by best score."""
    return ops.merged_max([_vector_hits(spark, sf_dir, 30), _keyword_hits(spark, sf_dir, 30)], 15).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC % 50}, {_KEY % 50} SELECT 'keyword' AS a, 'vector' AS b, count(*) AS shared, round(100.0 * count(*) / 50, 4) AS share FROM v JOIN k ON v.id = k.id HAVING count(*) > 0")
def strategy_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that two strategies share."""
    cols = ("strategy", "id")
    hits = _vector_hits(spark, sf_dir, 50).select(*cols).unionByName(_keyword_hits(spark, sf_dir, 50).select(*cols))
    return evaluation.overlap(hits, 50).select("a", "b", "shared", F.round("share", 4).alias("share"))


@query(f"WITH {_VEC % 50}, {_KEY % 50}, u AS (SELECT 'vector' AS strategy, score FROM v UNION ALL SELECT 'keyword', score FROM k) SELECT strategy, count(*) AS n, round(avg(score), 6) AS mean_score FROM u GROUP BY strategy")
def strategy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score by strategy."""
    cols = ("strategy", "score")
    hits = _vector_hits(spark, sf_dir, 50).select(*cols).unionByName(_keyword_hits(spark, sf_dir, 50).select(*cols))
    return evaluation.per_strategy(hits).select("strategy", "n", F.round("mean_score", 6).alias("mean_score"))


@query(f"WITH {_VEC % 100} SELECT v.id, d.source, round(v.score, 6) AS score FROM v JOIN documents d ON d.doc_id = v.id WHERE v.score >= 0.1 AND d.source IN ('src0', 'src1', 'src2', 'src3')")
def filter_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a least score from some sources."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    rows = _vector_hits(spark, sf_dir, 100).join(docs, "id")
    return ops.filtered(rows, 0.1, ["src0", "src1", "src2", "src3"]).select("id", "source", F.round("score", 6).alias("score"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of every user."""
    return ops.first_of_each(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT e.vec_id IS NOT NULL AS cached, count(*) AS n, min(d.doc_id) AS first_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1")
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with and without a vector in the cache."""
    cache = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("_hit"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(cache, "doc_id", "left")
    return rows.groupBy(F.coalesce("_hit", F.lit(False)).alias("cached")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(r"""WITH r AS (SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(13) || chr(10)) AS q, doc_id % 120 AS k FROM documents)
  SELECT doc_id, length(q) AS n_chars, CASE WHEN q = '' THEN 'empty query' WHEN k < 1 OR k > 100 THEN 'top_k out of range' END AS error FROM r""")
def checked_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests: trimmed, and refused if empty or if they ask for too many or no hits."""
    requests = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("query"), (F.col("doc_id") % 120).alias("top_k"))
    return ops.checked_requests(requests).select("doc_id", F.char_length("query").cast("long").alias("n_chars"), "error")


@query("SELECT vec_id, len(embedding) * 4 AS n_bytes, true AS same FROM embeddings")
def float_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector packed into bytes and unpacked."""
    from lexlake.functions.vectors import packed, unpacked

    rows = table(spark, sf_dir, "embeddings").withColumn("_bytes", packed(F.col("embedding")))
    return rows.select("vec_id", F.octet_length("_bytes").cast("long").alias("n_bytes"), (unpacked(F.col("_bytes")) == F.col("embedding")).alias("same"))


def _dense(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those of every fiftieth id as queries."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors, vectors.filter("id % 50 = 0").select(F.col("id").alias("query_no"), "vector")


@query(f"""SELECT query_no, id, rank FROM (SELECT q.vec_id AS query_no, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, e.vec_id) AS rank
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 10""")
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every fiftieth vector, through an inverted-file index of all: a few lists first, then those that may hold nearer ones."""
    vectors, queries = _dense(spark, sf_dir)
    path = scratch(spark, "vector-index")
    vector_index.create(vectors, path)
    found = vector_index.search(queries, path, 10, probes=4, exact=True)
    return found.select("query_no", "id", F.col("rank").cast("long").alias("rank"))


@query()
def index_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the nearest 13 of 16 lists alone, half of the vectors having been added to the index later. A test holds its recall."""
    vectors, queries = _dense(spark, sf_dir)
    path = scratch(spark, "vector-index")
    vector_index.create(vectors.filter("id % 2 = 0"), path, lists=16)
    vector_index.add(vectors.filter("id % 2 = 1"), path)
    return vector_index.search(queries, path, 10, probes=13).select("query_no", "id", F.col("rank").cast("long").alias("rank"))


@query("""WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS v FROM documents), a AS (SELECT doc_id, v::DOUBLE / count(*) OVER () AS score FROM d WHERE source = 'src3'),
  b AS (SELECT doc_id, 1.0::DOUBLE - (row_number() OVER (ORDER BY doc_id) - 1)::DOUBLE / count(*) OVER () AS score FROM (SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 15))
  SELECT 'subject' AS strategy, doc_id AS id, round(score, 6) AS score FROM b UNION ALL SELECT * FROM (SELECT 'versions', doc_id, round(score, 6) FROM a ORDER BY score DESC, doc_id LIMIT 15)""")
def graph_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the graph strategy's modes on documents: versions of a chain, a subject, an unknown mode (nothing), and one that fails (nothing)."""
    docs = table(spark, sf_dir, "documents")
    modes = {m: (lambda m=m, x=x: ops.graph_hits(docs, m, x, 15, chain="source", order="doc_id", subject="lang")) for m, x in (("versions", "src3"), ("subject", "de"), ("other", "x"))}
    found = ops.searched(modes | {"broken": lambda: docs.select("no_such_column")}, ["versions", "subject", "other", "broken"])
    return ops.hits_or_none(spark, found).select("strategy", "id", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC % 10} SELECT v.id, round(score, 6) AS score, d.lang || ' > ' || d.source || chr(10) || d.text AS rich_text FROM v LEFT JOIN documents d ON d.doc_id = v.id")
def hit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors with their documents' rich texts, fetched again by id."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("lang", F.lit(" > "), "source", F.lit("\n"), "text").alias("rich_text"))
    return ops.with_texts(_vector_hits(spark, sf_dir, 10), texts).select("id", F.round("score", 6).alias("score"), "rich_text")
