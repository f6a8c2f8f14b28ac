"""The queries of the subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.llm import alignment, audio, fingerprints, merkle, mixing, ngram_join, packing, quality, secret_scan, token_counts, token_files, toxicity, warc
from lexlake.llm.common import written
from lexlake.llm.oracles import SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of every text and of its edited text."""
    return fingerprints.edit_report(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text, found through the trigram index."""
    return secret_scan.report(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from positives and unlabelled text."""
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths of all documents with its suffix sums."""
    counted = token_counts.lengths(_table(spark, sf_dir, "documents"))
    return token_counts.suffix_sums(written(token_counts.histogram(counted), "token-histogram"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal documents by exact Jaccard similarity of 3-word shingles."""
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chroma fingerprints of all conversation turns, read out as sound, and the recordings that align with those of
    every fiftieth conversation. The tables hold no audio: words become chords before the operator sees them."""
    turns = _table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("recording"), "text")
    prints = audio.fingerprints(turns, ["recording"], "text", audio.rendered_pieces)
    found = audio.search(prints, "recording", F.coalesce(F.col("recording.conv_id") % 50 == 0, F.lit(False)))
    return found.select("recording.*", "*").drop("recording")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit-plane shuffled token-id files of all documents, written and read back."""
    return token_files.round_trip(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows beside lexical neighbours."""
    return packing.report(_table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes of each document."""
    return mixing.documents_taken(_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle digests, proofs and checks of all documents."""
    return merkle.report(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of all documents' tokens in two vocabularies, with the links' counts over all documents."""
    return alignment.report(_table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents, held against the quartiles of their language's source."""
    return quality.report(_table(spark, sf_dir, "documents"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op1: the edited text's digest of every document, which SQL can express."""
    return fingerprints.edit_report(_table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


def char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4: the histogram and its suffix sums with characters in place of tokens, which SQL can express."""
    counted = _table(spark, sf_dir, "documents").select(F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_tokens"))
    return token_counts.suffix_sums(token_counts.histogram(counted))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op10: the sources with their sizes and targets, which SQL can express."""
    return mixing.targets(mixing.sized(_table(spark, sf_dir, "documents"))).select("source", "source_size", F.round("target", 3).alias("target"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to builder."""
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_secrets": op2_secrets,
        "op4_token_counts": op4_token_counts,
        "op3_toxicity": op3_toxicity,
        "op5_warc": op5_warc,
        "op6_ngram_join": op6_ngram_join,
        "op7_audio": op7_audio,
        "op8_token_files": op8_token_files,
        "op9_packing": op9_packing,
        "op10_source_mix": op10_source_mix,
        "op11_merkle": op11_merkle,
        "op12_alignment": op12_alignment,
        "op13_quality": op13_quality,
        "fingerprint_edits": fingerprint_edits,
        "char_counts": char_counts,
        "mix_targets": mix_targets,
    }


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return dict(SQL)
