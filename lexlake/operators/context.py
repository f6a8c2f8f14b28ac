"""Context for answers: hits with their law and neighbours, version context, assembly, stub embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stub_embedding(text: Column, size: int = 16) -> Column:
    """A unit vector that follows from the text alone: bytes of its SHA-256, centred and scaled. Stands in for a model."""
    digest = F.sha2(text, 256)
    raw = F.array(*[F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("double") - 127.5 for k in range(size)])
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: x / length)


def cached_embeddings(texts: DataFrame, cache: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Hits (texts with the cache's vector) and the rows to add to the cache (key, embedding), one per new text."""
    keyed = texts.withColumn("key", F.sha2(text, 256))
    hits = keyed.join(cache, "key")
    misses = keyed.join(cache, "key", "left_anti").dropDuplicates(["key"])
    return hits, misses.select("key", stub_embedding(F.col(text)).alias("embedding"))


def articles_of(hits: DataFrame, articles: DataFrame, laws: DataFrame) -> DataFrame:
    """Hits (id, score) with the article's columns, its law's title, and the ids of the versions around it."""
    return hits.join(articles, "id").join(laws, "law_id", "left")


def version_context(versions: DataFrame, chain: list[str], order: list[str], id_: str, previous: int = 1) -> DataFrame:
    """id, previous_versions, next_versions: ids of up to ``previous`` versions before and of all after, in order, comma-joined."""
    along = Window.partitionBy(*chain).orderBy(*order)
    before = F.collect_list(id_).over(along.rowsBetween(-previous, -1))
    after = F.collect_list(id_).over(along.rowsBetween(1, Window.unboundedFollowing))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return versions.select(F.col(id_).alias("id"), text(before).alias("previous_versions"), text(after).alias("next_versions"))


def law_changes(events: DataFrame, affected: DataFrame) -> DataFrame:
    """event_id, target, source, articles: change events with their changed articles as 'id:kind', in order (none: empty)."""
    items = F.array_sort(F.collect_list(F.concat_ws(":", F.col("article_id").cast("string"), "change")))
    per = affected.groupBy("event_id").agg(F.array_join(items, ",").alias("articles"))
    return events.join(per, "event_id", "left").withColumn("articles", F.coalesce("articles", F.lit("")))


def accumulated(context: DataFrame, added: DataFrame, removed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Contexts (id, position; one, or one for each ``by``) after articles were added, each once and at its first place, and others removed."""
    by = by or []
    both = context.select(*by, "id", "position", F.lit(0).alias("_new")).unionByName(added.select(*by, "id", "position", F.lit(1).alias("_new")))
    first = both.groupBy(*by, "id").agg(F.min(F.struct("_new", "position")).alias("_at")).join(removed.select(*by, "id"), [*by, "id"], "left_anti")
    return first.select(*by, "id", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_at", "id")).alias("position"))


def assembled(lists: list[DataFrame], by: str) -> DataFrame:
    """One numbered context per ``by`` from several lists (by, id, position, text), earlier lists first: every id once,
    at its first place, with index from 1 and a labelled text."""
    union = reduce(DataFrame.unionByName, [x.select(by, "id", "position", "text").withColumn("_list", F.lit(k)) for k, x in enumerate(lists)])
    first = union.groupBy(by, "id").agg(F.min_by(F.struct("_list", "position", "text"), F.struct("_list", "position")).alias("_f"))
    index = F.row_number().over(Window.partitionBy(by).orderBy("_f._list", "_f.position", "id"))
    rows = first.withColumn("index", index)
    return rows.select(by, "id", "index", F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), F.col("_f.text")).alias("text"))


def reused(decisions: DataFrame, collected: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """key and context: what was collected, or where a decision says so the previous context."""
    rows = decisions.join(collected.withColumnRenamed("context", "_new"), key, "left").join(previous.withColumnRenamed("context", "_old"), key, "left")
    return rows.select(key, F.when(F.col("needs_search"), F.col("_new")).otherwise(F.col("_old")).alias("context"))


def question_queries(questions: DataFrame) -> DataFrame:
    """number, query: each question alone and with each of its options."""
    own = questions.select("number", F.col("question").alias("query"))
    options = questions.select("number", F.explode(F.map_values("options")).alias("_o"), "question")
    return own.unionByName(options.select("number", F.concat_ws(" ", "question", "_o").alias("query")))
