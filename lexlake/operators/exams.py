"""Exams as text: questions with options and answer keys, by line classification and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlake.functions.text import fold


# How lines begin that printing put into an exam, without accents: headings of sessions, bodies and pages.
PRINTED = ["primer ejercicio", "pagina", "consejo general del", "fiscalia general", "ministerio de la presidencia", "comision de seleccion", "acuerdo de"]
DIGITS, DASHES = "0123456789", ["-", "–", "—"]


def lines_of(exams: DataFrame) -> DataFrame:
    """exam_id, line_no, line of every line that isn't blank, a heading of the printing or only a page's number."""
    rows = exams.select("exam_id", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line"))
    bare = F.trim(fold(F.lower("line")))
    printed = F.lit(False)
    for words in PRINTED:
        printed = printed | bare.startswith(words)
    page = (bare != "") & (F.translate(bare, DIGITS + " ", "").isin("", "de"))
    return rows.filter((bare != "") & ~printed & ~page)


def marked(exams: DataFrame) -> DataFrame:
    """Lines with kind and value: a question (its number; a dash follows), an option (its letter; a bracket follows), a key (number, with the letter
    in ``text``), or a continuation; ``text`` is what follows the mark."""
    rows = lines_of(exams)
    line = F.ltrim("line")
    number = F.substring(line, F.lit(1), F.char_length(line) - F.char_length(F.ltrim(line, F.lit(DIGITS))))
    behind = F.substring(line, F.char_length(number) + 1, F.lit(1 << 30))
    after = F.ltrim(behind, F.lit(". \t"))
    said = F.trim(F.substring(after, 2, 1 << 30))
    is_question = (number != "") & F.substring(after, 1, 1).isin(DASHES) & (said != "")
    is_key = (number != "") & (after != behind) & F.lower(F.trim(after)).isin("a", "b", "c", "d")
    letter = F.lower(F.substring(line, 1, 1))
    choice = F.trim(F.substring(line, 3, 1 << 30))
    is_option = letter.isin("a", "b", "c", "d") & (F.substring(line, 2, 1) == ")") & (choice != "")
    kind = F.when(is_key, "key").when(is_question, "question").when(is_option, "option").otherwise("more")
    value = F.when(is_key | is_question, number).when(is_option, letter)
    text = F.when(is_key, F.lower(F.trim(after))).when(is_question, said).when(is_option, choice).otherwise(F.trim("line"))
    return rows.select("exam_id", "line_no", kind.alias("kind"), value.alias("value"), text.alias("text"))


def questions(exams: DataFrame) -> DataFrame:
    """exam_id, place, number, question, options (map of letter to text). Texts may run over several lines; questions are told apart by
    place, so numbers may repeat; of a letter given twice in a question the texts are one after the other."""
    order = Window.partitionBy("exam_id").orderBy("line_no")
    rows = marked(exams).filter("kind <> 'key'")
    rows = rows.withColumn("place", F.count(F.when(F.col("kind") == "question", True)).over(order)).filter("place > 0")
    of_question = Window.partitionBy("exam_id", "place").orderBy("line_no")
    rows = rows.withColumn("part", F.coalesce(F.last(F.when(F.col("kind") == "option", F.col("value")), ignorenulls=True).over(of_question), F.lit("")))
    rows = rows.withColumn("number", F.first(F.col("value").try_cast("int")).over(of_question))
    parts = rows.groupBy("exam_id", "place", "number", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"))
    options = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("part") != "", F.struct("part", "text")))))
    return parts.groupBy("exam_id", "place", "number").agg(F.max(F.when(F.col("part") == "", F.col("text"))).alias("question"), options.alias("options"))


def answer_key(exams: DataFrame) -> DataFrame:
    """exam_id, number, answer from lines of a number and a letter; of several the last."""
    keys = marked(exams).filter("kind = 'key'")
    return keys.groupBy("exam_id", F.col("value").try_cast("int").alias("number")).agg(F.max_by("text", "line_no").alias("answer"))


def prompts(rows: DataFrame) -> DataFrame:
    """exam_id, number, prompt: the question with its options, a line each."""
    lines = F.transform(F.map_entries("options"), lambda e: F.concat(e["key"], F.lit(") "), e["value"]))
    return rows.select("exam_id", "number", F.concat_ws("\n", "question", lines).alias("prompt"))
