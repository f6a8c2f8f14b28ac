"""Spanish number words: a table of spellings built from a rule, and joins with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.functions.text import article_number, fold

# Number words without marks.
UNITS = ["cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "trece", "catorce", "quince"]
TENS = {20: "veinte", 30: "treinta", 40: "cuarenta", 50: "cincuenta", 60: "sesenta", 70: "setenta", 80: "ochenta", 90: "noventa"}
HUNDREDS = {1: "ciento", 2: "doscientos", 3: "trescientos", 4: "cuatrocientos", 5: "quinientos", 6: "seiscientos", 7: "setecientos", 8: "ochocientos", 9: "novecientos"}
ORDINALS = ["primero", "segundo", "tercero", "cuarto", "quinto", "sexto", "septimo", "octavo", "noveno", "decimo"]
ORDINAL_TENS = {20: "vigesimo", 30: "trigesimo", 40: "cuadragesimo", 50: "quincuagesimo", 60: "sexagesimo", 70: "septuagesimo", 80: "octogesimo", 90: "nonagesimo", 100: "centesimo"}


def _below_hundred(n: int) -> list[str]:
    if n < 16:
        return [UNITS[n]]
    if n < 20:
        return ["dieci" + UNITS[n - 10]]
    if n < 30:
        return [TENS[20]] if n == 20 else ["veinti" + UNITS[n - 20]]
    return [TENS[n - n % 10] + (f" y {UNITS[n % 10]}" if n % 10 else "")]


def cardinal(n: int) -> list[str]:
    """Spellings of a number from 0 to 999, masculine and feminine."""
    tail = _below_hundred(n % 100) if n < 100 or n % 100 else [""]
    if n < 100:
        words = tail
    elif n == 100:
        words = ["cien", "ciento"]
    else:
        words = [f"{HUNDREDS[n // 100]} {t}".strip() for t in tail]
    words += [w.replace("cientos", "cientas").replace("quinientos", "quinientas") for w in words if n >= 200]
    for w in list(words):
        if w.endswith("uno"):
            words += [w[:-1], w[:-1] + "a"]
    return list(dict.fromkeys(words))


def ordinal(n: int) -> list[str]:
    """Spellings of an ordinal from 1 to 100, masculine and feminine."""
    if n <= 10:
        words = [ORDINALS[n - 1]] + ([ORDINALS[n - 1][:-1]] if n in (1, 3) else [])
    elif n in (11, 12):
        words = [["undecimo", "duodecimo"][n - 11]]
    elif n < 20:
        words = ["decimo" + ORDINALS[n - 11], "decimo " + ORDINALS[n - 11], "decima " + ORDINALS[n - 11][:-1] + "a"]
    else:
        words = [(ORDINAL_TENS[n - n % 10] + " " + (ORDINALS[n % 10 - 1] if n % 10 else "")).strip()]
    return list(dict.fromkeys(words + [" ".join(p[:-1] + "a" if p.endswith("o") else p for p in w.split(" ")) for w in words]))


def spellings(spark: SparkSession) -> DataFrame:
    """spelling, value: the fixed table of all spellings, about two thousand rows."""
    rows = {w: n for n in range(1, 101) for w in ordinal(n)} | {w: n for n in range(1000) for w in cardinal(n)}
    return spark.createDataFrame(sorted(rows.items()), "spelling string, value int")


def _spoken(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold(c)), r"[\s_]+", " "))


def with_number(df: DataFrame, words: str, out: str) -> DataFrame:
    """``df`` with the number that its words spell; null if none."""
    table = F.broadcast(spellings(df.sparkSession).select(F.col("spelling").alias("_spelling"), F.col("value").alias(out)))
    return df.join(table, _spoken(F.col(words)) == F.col("_spelling"), "left").drop("_spelling")


def with_article_number(df: DataFrame, title: str, out: str) -> DataFrame:
    """``df`` with the number of an article title, in digits or in words after 'Artículo'."""
    spoken = F.nullif(F.regexp_extract(_spoken(F.col(title)), r"^(?:articulos?|arts?\.?)\s*(.*)$", 1), F.lit(""))
    df = with_number(df.withColumn("_title", spoken), "_title", "_number")
    return df.withColumn(out, F.coalesce(article_number(F.col(title)), F.col("_number").cast("string"))).drop("_title", "_number")
