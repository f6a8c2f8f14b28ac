"""Linking: citations of articles become edges to the article version in force, or to the law."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.functions.citations import KNOWN_LAWS, citations, law_key, reference_type
from lexlake.functions.text import reference_kind
from lexlake.operators.versions import valid_at
from lexlake.session import written


def known_laws(spark) -> DataFrame:
    """key, law_id: the fixed table of known laws."""
    return spark.createDataFrame(sorted(KNOWN_LAWS.items()), "key string, law_id string")


def extracted(articles: DataFrame) -> DataFrame:
    """One row per citation of articles (article_id, law_id, clean_number, full_text, valid_from): ref_id, its parts,
    reference_type, the law it names (target_law) and the article (target_number; neighbours resolved)."""
    rows = articles.select("article_id", "law_id", "clean_number", "valid_from", F.posexplode(citations("full_text")).alias("place", "c"))
    own = F.regexp_extract(F.coalesce("clean_number", F.lit("")), r"^(\d+)", 1).try_cast("int")
    step = F.when(F.col("c.relative") == "siguiente", 1).when(F.col("c.relative").isNotNull(), -1)
    number = F.coalesce(F.when(F.col("c.range_end").isNull(), F.col("c.article")), (own + step).cast("string"))
    rows = rows.select(F.concat_ws("#", "article_id", F.col("place").cast("string")).alias("ref_id"), "article_id", "law_id", "valid_from", "c", reference_type(F.col("c")).alias("reference_type"), law_key(F.col("c")).alias("key"), number.alias("target_number"))
    known = F.broadcast(known_laws(articles.sparkSession).withColumnRenamed("law_id", "_known"))
    rows = rows.join(known, "key", "left")
    return rows.withColumn("target_law", F.when(F.col("c.is_external"), F.col("_known")).otherwise(F.col("law_id"))).drop("_known")


def linked(refs: DataFrame, versions: DataFrame) -> DataFrame:
    """src, rel, dst, raw: each citation's edge to the article in force when the citing version began, else to its law.

    ``versions``: article_id, law_id, clean_number, valid_from, valid_to. Set-based: an equi-join on
    law and number with the validity as residual, the latest start winning. What several citations ask, one article of one law
    at one time, is answered once, so an article that most cite takes no task for itself.
    """
    asks = refs.filter("target_law IS NOT NULL").select("article_id", F.col("target_law").alias("law_id"), F.col("target_number").alias("clean_number"), "valid_from", "c")
    # an absent part and an empty one are different questions
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    asks = asks.withColumn("_ask", F.concat_ws("\x1f", *map(part, ("law_id", "clean_number", "valid_from"))))
    questions = written(asks.select("_ask", "law_id", "clean_number", F.col("valid_from").alias("_at")).dropDuplicates(["_ask"]), "link-questions")
    own = versions.select("law_id", "clean_number", F.col("article_id").alias("_target"), "valid_from", "valid_to")
    found = valid_at(questions.filter("clean_number IS NOT NULL"), own, ["law_id", "clean_number"], "_ask", "_at", "_target")
    laws = versions.select("law_id").distinct().withColumn("_known", F.lit(True))
    answers = questions.join(found, "_ask", "left").join(laws, "law_id", "left")
    answers = answers.select("_ask", F.coalesce("target_id", F.when(F.col("_known"), F.col("law_id"))).alias("dst")).filter("dst IS NOT NULL")
    rows = asks.join(answers, "_ask")
    rows = rows.select(F.col("article_id").alias("src"), reference_kind(F.col("c.raw")).alias("rel"), "dst", F.substring("c.raw", 1, 200).alias("raw"))
    return rows.filter("dst IS NOT NULL AND dst <> src").dropDuplicates(["src", "rel", "dst"])


def unresolved(refs: DataFrame) -> DataFrame:
    """External citations whose law isn't known, with how often they occur."""
    return refs.filter("c.is_external AND target_law IS NULL").groupBy("key", "reference_type").agg(F.count("*").alias("n"))
