"""Queries of scalar text functions: over documents and pages, and over fixtures given in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.functions import numbers
from lexlake.functions import text as fn
from lexlake.plans.catalogue import query, table


# How numbers are spelled, without accents: 0 to 29, tens from 30, hundreds from 100 (before others; alone 'cien').
UNITS = "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciseis diecisiete dieciocho diecinueve veinte veintiuno veintidos veintitres veinticuatro veinticinco veintiseis veintisiete veintiocho veintinueve".split()
TENS = "treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
HUNDREDS = "ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos".split()


def _spelled(n: str, div: str, of: str) -> str:
    """An expression of the words of a number below 1000, in Spark (div: DIV, lists by ``element_at``) or DuckDB (//, ``list_extract``)."""
    pick = lambda words, i: f"{of}({'array' if of == 'element_at' else 'list_value'}({', '.join(repr(w) for w in words)}), cast({i} as int))"
    low = f"({n}) % 100"
    small = f"CASE WHEN {low} < 30 THEN {pick(UNITS, f'1 + {low}')} ELSE concat({pick(TENS, f'{low} {div} 10 - 2')}, CASE WHEN {low} % 10 > 0 THEN concat(' y ', {pick(UNITS, f'1 + {low} % 10')}) ELSE '' END) END"
    return f"CASE WHEN ({n}) < 100 THEN {small} WHEN ({n}) = 100 THEN 'cien' ELSE concat({pick(HUNDREDS, f'({n}) {div} 100')}, CASE WHEN {low} > 0 THEN concat(' ', {small}) ELSE '' END) END"


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of every whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", fn.content_hash(F.col("text")).alias("hash"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def iso_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of eight digits written with hyphens."""
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.iso_date(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMMdd")).alias("iso"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title of every page."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT doc_id, length(text) // 4 AS tokens, substr(text, 1, 200) AS cut FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens and the start of every text."""
    return table(spark, sf_dir, "documents").select("doc_id", fn.token_estimate(F.col("text")).alias("tokens"), F.substring("text", 1, 200).alias("cut"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'deroga') THEN 'DEROGATES' WHEN contains(lower(text), 'modifica') THEN 'MODIFIES' ELSE 'REFERS_TO' END AS kind FROM documents")
def ref_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge that every text asks for."""
    return table(spark, sf_dir, "documents").select("doc_id", fn.reference_kind(F.col("text")).alias("kind"))


@query("SELECT o_orderkey, 'change_' || substr(sha256(o_orderkey || ':' || o_custkey), 1, 16) AS change_id FROM orders")
def change_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of change events."""
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.change_id(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("change_id"))


@query(f"SELECT o_orderkey, {_spelled('o_orderkey % 1000', '//', 'list_extract')} AS word, o_orderkey % 1000 AS number FROM orders")
def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three digits of every order in Spanish words, as numbers again, by a join with their spellings."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_spelled("o_orderkey % 1000", "DIV", "element_at")).alias("word"))
    return numbers.with_number(rows, "word", "number").select("o_orderkey", "word", F.col("number").cast("long").alias("number"))


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 997 AS n FROM orders)
  SELECT k AS o_orderkey, CASE k % 7 WHEN 0 THEN n::VARCHAR WHEN 1 THEN n || ' bis' WHEN 2 THEN n::VARCHAR WHEN 3 THEN (1000 * (1 + k % 9) + n)::VARCHAR WHEN 4 THEN n::VARCHAR WHEN 5 THEN n || ' ' || substr('terquater', CASE WHEN n % 2 = 0 THEN 1 ELSE 4 END, CASE WHEN n % 2 = 0 THEN 3 ELSE 6 END) END AS number FROM o""")
def article_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of article titles made of every order's key: in digits, with suffix, section, thousands or ordinal sign, in words, or without a number."""
    titles = ["concat('Artículo ', n, '.')", "concat('Art. ', n, ' bis')", "concat('Artículo ', n, '.', 1 + k % 9)", "concat('artículo ', 1 + k % 9, '.', lpad(n, 3, '0'), '. Objeto')", f"concat('ARTÍCULO ', {_spelled('n', 'DIV', 'element_at')})", "concat('Artículo ', n, if(n % 2 = 0, ' ter', ' quáter'), '. Casos')", "concat('Disposición adicional ', n)"]
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 997).alias("n"))
    rows = rows.select(F.col("k").alias("o_orderkey"), F.expr(f"element_at(array({', '.join(titles)}), cast(k % 7 as int) + 1)").alias("title"))
    return numbers.with_article_number(rows, "title", "number").select("o_orderkey", "number")


@query("""WITH p AS (SELECT p_partkey AS k, 'Ley de la ' || p_type || ' y ' || p_brand AS title FROM part), w AS (SELECT k, title, list_filter(string_split(lower(title), ' '), lambda x: x NOT IN ('de', 'la', 'y', '')) AS w FROM p)
  SELECT k AS p_partkey, CASE WHEN k % 5 = 0 THEN 'ref_' ELSE 'art_' || k || CASE WHEN k % 5 = 1 THEN '_b_' ELSE '_' END END || substr(array_to_string(list_transform(w, lambda x: x[1]), ''), 1, 4) || CASE WHEN k % 3 = 0 THEN '' ELSE '_' || right('BOE-A-' || k, 6) END AS key FROM w""")
def cite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation keys made of every part's key, kind and brand."""
    k = F.col("p_partkey")
    number = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Artículo "), k, F.when(k % 5 == 1, ".b").otherwise("")))
    title = F.concat(F.lit("Ley de la "), "p_type", F.lit(" y "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", fn.cite_key(number, title, F.when(k % 3 != 0, F.concat(F.lit("BOE-A-"), k))).alias("key"))


@query("""WITH c AS (SELECT o_orderkey, '3' || strftime(o_orderdate, '%Y') || substr('RLDHCS', 1 + (o_orderkey % 6)::INT, 1) || o_orderkey AS celex FROM orders)
  SELECT o_orderkey, celex, CASE celex[6] WHEN 'R' THEN 'REG' WHEN 'L' THEN 'DIR' WHEN 'D' THEN 'DEC' WHEN 'H' THEN 'REC' WHEN 'C' THEN 'OPI' ELSE 'OTHER' END AS kind FROM c""")
def celex_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of acts by CELEX numbers made of every order's year and key."""
    letter = F.substring(F.lit("RLDHCS"), (F.col("o_orderkey") % 6 + 1).cast("int"), F.lit(1))
    celex = F.concat(F.lit("3"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy"), letter, F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", celex.alias("celex")).withColumn("kind", fn.celex_type(F.col("celex")))


@query("SELECT c_custkey, lower(c_mktsegment) || ' ' || c_custkey AS folded FROM customer")
def fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of every customer's segment, with accents put in and a prefix before a dot, without all of these."""
    name = F.concat(F.lit("x.é."), F.translate("c_mktsegment", "AEIOUN", "ÁËÎÒÚÑ"), F.lit(" / -"), F.col("c_custkey"), F.lit("!"))
    return table(spark, sf_dir, "customer").select("c_custkey", fn.normalized(name).alias("folded"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 < 8 THEN substr('abcd', 1 + (c_custkey // 9 % 4)::INT, 1) END AS letter FROM customer")
def answer_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option that an answer, made for every customer in one of nine forms, names."""
    forms = ["l", "concat(l, ') porque ', c)", "concat('(', upper(l), ') es lo justo')", "concat('Mi Respuesta: ', upper(l), ' sin más')", "concat('Es por opción ', l)", "concat('La ', l, ' es')", "concat('es un ', l, ' ')", "concat('xyz ', l, c)", "concat('no sé, ', c)"]
    letter = F.substring(F.lit("abcd"), (F.expr("c DIV 9 % 4") + 1).cast("int"), F.lit(1))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c")).withColumn("l", letter)
    answer = F.expr(f"element_at(array({', '.join(forms)}), cast(c % 9 as int) + 1)")
    return rows.select(F.col("c").alias("c_custkey"), fn.answer_letter(answer).alias("letter"))


@query("""SELECT o_orderkey, substr('LC', 1 + (o_orderkey % 2)::INT, 1) AS series, o_orderkey::VARCHAR AS number, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS date FROM orders""")
def journal_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official-journal references, one made of every order, in parts; every third has no date."""
    series = F.substring(F.lit("LC"), (F.col("o_orderkey") % 2 + 1).cast("int"), F.lit(1))
    day = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(", "), F.date_format(F.col("o_orderdate").cast("timestamp"), "dd/MM/yyyy"), F.lit(", p. 1"))).otherwise("")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("OJ "), series, F.lit(" "), F.col("o_orderkey").cast("string"), day).alias("ref"))
    return rows.withColumn("r", fn.journal_reference(F.col("ref"))).select("o_orderkey", "r.series", "r.number", "r.date")


@query("""SELECT doc_id, trim(regexp_replace(lower(translate(str_split(text, '.')[-1], 'áàäâãåéèëêíìïîóòöôõúùüûñçýÿÁÀÄÂÃÅÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇÝ', 'aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY')), '[^a-z0-9]+', ' ', 'g')) AS folded FROM documents""")
def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the last dot of every document, folded."""
    return table(spark, sf_dir, "documents").select("doc_id", fn.normalized(F.col("text")).alias("folded"))


@query(r"""WITH t AS (SELECT conv_id, turn, lower(trim(text)) AS t FROM conversations)
  SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^[abcd]([^\p{L}]|$)') THEN t[1] WHEN regexp_matches(t, '^\([abcd]\)') THEN t[2]
    WHEN regexp_matches(t, 'respuesta[ \t\r\n\f\v]*:?[ \t\r\n\f\v]*[abcd]') THEN regexp_extract(t, 'respuesta[ \t\r\n\f\v]*:?[ \t\r\n\f\v]*([abcd])', 1)
    WHEN regexp_matches(t, 'opción[ \t\r\n\f\v]*:?[ \t\r\n\f\v]*[abcd]') THEN regexp_extract(t, 'opción[ \t\r\n\f\v]*:?[ \t\r\n\f\v]*([abcd])', 1)
    WHEN regexp_matches(t, '^la[ \t\r\n\f\v]+[abcd]([^\pL\pN_]|$)') THEN regexp_extract(t, '^la[ \t\r\n\f\v]+([abcd])', 1)
    WHEN regexp_matches(t, '(^|[^\pL\pN_])[abcd][ \t\r\n\f\v]*$') THEN regexp_extract(t, '([abcd])[ \t\r\n\f\v]*$', 1)
    ELSE nullif(regexp_extract(t, '[abcd]', 0), '') END AS letter FROM t""")
def answer_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option that every message names."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.answer_letter(F.col("text")).alias("letter"))
