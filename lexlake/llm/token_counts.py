"""Token counts: an exact histogram of encoded lengths and its suffix sums.

``histogram`` aggregates the documents by encoded length; ``suffix_sums`` turns it into the
answers for every context limit: documents and tokens at or above a length, tokens kept when
texts are cut there, quantiles. All of it is exact and mergeable: histograms of parts add up.

Defined results: a null or empty text has length 0 and counts as a document; repeated rows count
each; an empty table has an empty histogram; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlake.llm.common import arrow_rows
from lexlake.llm.encoding import BYTE_VOCAB, Encoder, pieces


def lengths(docs: DataFrame, vocabulary: str = BYTE_VOCAB) -> DataFrame:
    """doc_id and n_tokens of every whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(vocabulary)
        for b in batches:
            for doc_ids, texts in pieces(b):
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(enc.lengths(texts), pa.int64())], ["doc_id", "n_tokens"])

    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """n_tokens and docs, the number of documents of that length."""
    return counted.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per length: n_tokens, docs, docs_from (of this length or longer), tokens_from (theirs),
    docs_all, tokens_all, cut_tokens (all tokens when every text is cut to n_tokens), share_below
    (of documents shorter: the quantile that this length starts).
    """
    both = hist.withColumn("_tokens", F.col("docs") * F.col("n_tokens"))
    below = Window.partitionBy("_run").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    runs = both.withColumn("_run", F.expr("n_tokens div 64"))
    sums = runs.groupBy("_run").agg(F.sum("docs").alias("_d"), F.sum("_tokens").alias("_t"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    sums = sums.select(
        "_run",
        F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_db"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_tb"),
        F.sum("_d").over(every).alias("docs_all"),
        F.sum("_t").over(every).alias("tokens_all"),
    )
    runs = runs.withColumns({"_dn": F.coalesce(F.sum("docs").over(below), F.lit(0)), "_tn": F.coalesce(F.sum("_tokens").over(below), F.lit(0))})
    rows = runs.join(sums, "_run")
    docs_below, tokens_below = F.col("_db") + F.col("_dn"), F.col("_tb") + F.col("_tn")
    return rows.select(
        "n_tokens",
        "docs",
        (F.col("docs_all") - docs_below).alias("docs_from"),
        (F.col("tokens_all") - tokens_below).alias("tokens_from"),
        "docs_all",
        "tokens_all",
        (tokens_below + (F.col("docs_all") - docs_below) * F.col("n_tokens")).alias("cut_tokens"),
        (docs_below / F.col("docs_all")).alias("share_below"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context, docs_over, cut_tokens for each limit, lengths in between included: in one pass, from the row of
    ``sums`` per limit whose length is the shortest above it (none: no text is longer)."""
    context = F.explode(F.array(*[F.lit(n).cast("long") for n in limits])).alias("context")
    rows = sums.select(context, "n_tokens", "docs_from", "tokens_from", "tokens_all")
    above = F.min(F.when(F.col("n_tokens") > F.col("context"), F.struct("n_tokens", "docs_from", "tokens_from"))).alias("_a")
    found = rows.groupBy("context").agg(above, F.max("tokens_all").alias("_all"))
    over = F.coalesce("_a.docs_from", F.lit(0))
    found = found.select("context", over.alias("docs_over"), (F.col("_all") - F.coalesce("_a.tokens_from", F.lit(0)) + over * F.col("context")).alias("cut_tokens"))
    return found


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share and n_tokens: the least length that at least that share of documents does not exceed."""
    upto = (F.col("docs_all") - F.col("docs_from") + F.col("docs")) / F.col("docs_all")
    each = F.array(*[F.struct(F.lit(float(q)).alias("share"), F.when(upto >= q, F.col("n_tokens")).alias("n")) for q in shares])
    return sums.select(F.explode(each).alias("e")).groupBy("e.share").agg(F.min("e.n").alias("n_tokens"))
