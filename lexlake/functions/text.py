"""Scalar text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Letters with marks and what they fold to.
ACCENTED = "áàäâãåéèëêíìïîóòöôõúùüûñçýÿÁÀÄÂÃÅÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇÝ"
FOLDED = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"

# Terms that call for a search.
LEGAL_TERMS = [
    "artículo", "articulo", "art.", "ley", "leyes", "normativa", "normativo", "código", "codigo", "reglamento", "decreto",
    "constitución", "constitucion", "sentencia", "jurisprudencia", "tribunal", "juzgado", "demanda", "recurso", "apelación", "apelacion",
    "casación", "casacion", "amparo", "habeas corpus", "real decreto", "orden ministerial", "disposición", "disposicion", "transitoria", "derogatoria",
]
# Remarks that only ask back, as expressions over a message in lower case.
CLARIFICATIONS = [
    r"^\s*¿?(estás?|estas?) seguro\??$",
    r"^\s*¿?seguro\??$",
    r"^\s*¿?de verdad\??$",
    r"^\s*¿?en serio\??$",
    r"^\s*¿?por qué\??$",
    r"^\s*¿?cómo\??$",
    r"^\s*ok$",
    r"^\s*vale$",
    r"^\s*entiendo$",
    r"^\s*ya veo$",
]
MAX_SHORT_WORDS = 6

# Connecting words that don't count in an abbreviation.
STOP_WORDS = ["de", "la", "el", "del", "los", "las", "y", "en", "para"]

# The letter of a CELEX number that tells the kind of act.
CELEX_TYPES = {"R": "REG", "L": "DIR", "D": "DEC", "H": "REC", "C": "OPI"}

# Month names for dates in words.
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]


def fold(c: Column) -> Column:
    """Letters without their marks."""
    return F.translate(c, ACCENTED, FOLDED)


def normalized(c: Column) -> Column:
    """What follows the last dot, folded, in lower case, everything but letters and digits as single spaces."""
    last = F.element_at(F.split(c, r"\."), -1)
    return F.trim(F.regexp_replace(F.lower(fold(last)), "[^a-z0-9]+", " "))


def constant_name(c: Column) -> Column:
    """A name as an upper-case constant."""
    return F.upper(F.replace(normalized(c), F.lit(" "), F.lit("_")))


def content_hash(c: Column) -> Column:
    """SHA-256 of a text in hexadecimal."""
    return F.sha2(c, 256)


def change_id(target: Column, source: Column) -> Column:
    """Id of the change event of two laws."""
    return F.concat(F.lit("change_"), F.substring(F.sha2(F.concat_ws(":", target, source), 256), 1, 16))


def iso_date(c: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD, anything else as it is."""
    parts = F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))
    return F.when(F.rlike(c, F.lit("^[0-9]{8}$")), parts).otherwise(c)


def date_in_words(c: Column) -> Column:
    """A date as '5 de marzo de 2024'."""
    months = F.array(*map(F.lit, MONTHS))
    return F.concat(F.dayofmonth(c).cast("string"), F.lit(" de "), F.element_at(months, F.month(c)), F.lit(" de "), F.year(c).cast("string"))


def parsed_date(c: Column) -> Column:
    """A date written as YYYYMMDD, ISO, DD/MM/YYYY or DD.MM.YYYY; anything else is null."""
    return F.coalesce(*[F.try_to_date(c, f) for f in ("yyyyMMdd", "yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy")])


# Words that name an article before its number, and Latin words that follow one, without accents.
ARTICLE_WORDS = ["articulo", "articulos", "art", "arts"]
LATIN_SUFFIXES = ["bis", "ter", "quater", "quinquies", "sexies", "septies", "octies"]


def title_words(c: Column) -> Column:
    """The words of a title, folded, in lower case; a word that names an article stands apart from a number at its dot."""
    low = F.regexp_replace(fold(F.lower(c)), r"\b(arts?)\.", "$1. ")
    return F.filter(F.split(low, r"\s+"), lambda w: w != "")


def is_digits(c: Column) -> Column:
    """Whether a text is digits only, one at least."""
    return (c != "") & (F.translate(c, "0123456789", "") == "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it reads several times: worked out once, where Spark would work out an array's function at each place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def article_number(c: Column) -> Column:
    """The number of an article title in digits, from the word after 'Artículo' or 'Art.' or from the first word: its groups of
    three digits after a dot are thousands, what follows those is a section and dropped; a Latin word after it stays. Null without a number."""

    def grown(so_far: Column, group: Column) -> Column:
        more = so_far["open"] & is_digits(group) & (F.char_length(group) == 3)
        return F.struct(F.when(more, F.concat(so_far["text"], group)).otherwise(so_far["text"]).alias("text"), more.alias("open"))

    def number(groups: Column) -> Column:
        start = F.struct(F.get(groups, F.lit(0)).alias("text"), F.lit(True).alias("open"))
        return F.aggregate(F.slice(groups, 2, 8), start, grown, lambda x: x["text"])

    def read(words: Column) -> Column:
        """From the word that has the number on."""
        word = F.substring_index(F.rtrim(F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lit(".,:;-ªº°")), ",", 1)
        after = F.rtrim(F.coalesce(F.get(words, F.lit(1)), F.lit("")), F.lit(".,:;"))
        suffixed = lambda n: F.when(is_digits(n), F.when(after.isin(LATIN_SUFFIXES), F.concat_ws(" ", n, after)).otherwise(n))
        return bound(bound(F.split(word, "[.]"), number), suffixed)

    def told(words: Column) -> Column:
        is_article = F.rtrim(F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lit(".")).isin(ARTICLE_WORDS)
        return F.slice(words, F.when(is_article, 2).otherwise(1), 2)

    return bound(bound(title_words(c), told), read)


def reference_kind(c: Column) -> Column:
    """The edge that a citation's surroundings ask for."""
    low = F.lower(c)
    return F.when(low.contains("deroga"), "DEROGATES").when(low.contains("modifica"), "MODIFIES").otherwise("REFERS_TO")


def celex_type(c: Column) -> Column:
    """Kind of act of a CELEX number by its sixth character."""
    kinds = F.create_map(*[F.lit(x) for kv in CELEX_TYPES.items() for x in kv])
    return F.when(F.char_length(c) < 6, "OTHER").otherwise(F.coalesce(kinds[F.upper(F.substring(c, 6, 1))], F.lit("OTHER")))


def journal_reference(c: Column) -> Column:
    """series, number, date of an official-journal reference; nulls if it is none."""
    pattern = r"^OJ\s+([LC])\s+(\d+),?\s*(\d{2}/\d{2}/\d{4})?"
    part = lambda k: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    return F.struct(part(1).alias("series"), part(2).alias("number"), part(3).alias("date"))


def key_text(c: Column) -> Column:
    """Folded lower-case text with underscores between its words."""
    return F.btrim(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def cite_key(number: Column, title: Column, id_: Column) -> Column:
    """art_<number>_<initials>_<end of id>."""
    bare = key_text(F.regexp_replace(F.lower(number), r"^art[íi]culo\s*", ""))
    words = F.filter(F.split(F.lower(title), r"\s+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    initials = F.substring(F.array_join(F.transform(words, lambda w: fold(F.substring(w, 1, 1))), ""), 1, 4)
    initials = F.when(initials == "", key_text(F.substring(title, 1, 10))).otherwise(initials)
    base = F.when(bare == "", F.concat(F.lit("ref_"), initials)).otherwise(F.concat_ws("_", F.lit("art"), bare, initials))
    return F.when(F.coalesce(id_, F.lit("")) == "", base).otherwise(F.concat_ws("_", base, F.substring(id_, -6, 6)))


def with_previous_answer(messages: DataFrame) -> DataFrame:
    """``messages`` with has_previous: an answer came earlier in the conversation."""
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("has_previous", F.coalesce(F.bool_or(F.col("role") == "assistant").over(earlier), F.lit(False)))


def context_decision(message: Column, has_previous: Column, similarity: Column | None = None, threshold: float = 0.85) -> Column:
    """needs_search, reason, confidence: long messages and legal terms need a search, short remarks reuse the context."""
    q = F.lower(F.btrim(message, F.lit(" \t\n\r")))
    n = F.size(F.filter(F.split(message, r"\s+"), lambda w: w != ""))
    out = lambda need, why, sure: F.struct(F.lit(need).alias("needs_search"), F.lit(why).alias("reason"), F.lit(sure).alias("confidence"))
    alike = F.lit(False) if similarity is None else F.coalesce(similarity >= threshold, F.lit(False))
    remark = F.rlike(q, F.lit("|".join(CLARIFICATIONS)))
    # whole words, in the sense of Unicode: 'leyenda' is no 'ley', and 'art.' needs something right after it
    legal = F.rlike(q, F.lit(r"(?U)\b(?:" + "|".join(t.replace(".", "[.]") for t in LEGAL_TERMS) + r")\b"))
    return (
        F.when(n > MAX_SHORT_WORDS, out(True, "query_too_long", 1.0))
        .when(legal, out(True, "contains_legal_terms", 1.0))
        .when(remark & has_previous, out(False, "matches_clarification_pattern", 0.95))
        .when(remark | (alike & ~has_previous), out(True, "no_previous_context", 0.8))
        .when(alike, out(False, "high_embedding_similarity", 0.85))
        .when(~has_previous, out(True, "no_previous_context", 1.0))
        .otherwise(out(True, "default", 0.7))
    )


_LETTERS, _BLANKS = ["a", "b", "c", "d"], " \t\n\r\f\x0b"


def _option(c: Column) -> Column:
    """The first character of a text if it is an option's letter."""
    first = F.substring(c, 1, 1)
    return F.when(first.isin(_LETTERS), first)


def _named_after(t: Column, lead: str) -> Column:
    """The first option that stands right after a lead word, blanks and a colon aside."""

    def of(rest: Column) -> Column:
        bare = F.ltrim(rest, F.lit(_BLANKS))
        return _option(F.when(bare.startswith(":"), F.ltrim(F.substring(bare, 2, 1 << 30), F.lit(_BLANKS))).otherwise(bare))

    return F.get(F.array_compact(F.transform(F.slice(F.split(t, lead), 2, 1 << 30), of)), F.lit(0))


def answer_letter(c: Column) -> Column:
    """The option a-d that an answer names, by the first of these that it has: a letter at its start with no letter after it, one in brackets there, one
    after 'respuesta' or after 'opción', one after a first word 'la', one as its last word. Else the first such letter within any of its words, so that
    'ninguna' is a; null without one."""
    t = F.lower(F.trim(c))
    second, third = F.substring(t, 2, 1), F.substring(t, 3, 1)
    after_la = F.ltrim(F.substring(t, 3, 1 << 30), F.lit(_BLANKS))
    word = r"[\p{L}\p{N}_]"
    last = F.rtrim(t, F.lit(_BLANKS))
    before_last = F.substring(last, -2, 2)
    return F.coalesce(
        F.when(~F.rlike(second, F.lit(r"\p{L}")), _option(t)),
        F.when((F.substring(t, 1, 1) == "(") & (third == ")"), _option(second)),
        _named_after(t, "respuesta"),
        _named_after(t, "opción"),
        F.when(t.startswith("la") & second.isNotNull() & F.ltrim(third, F.lit(_BLANKS)).isin("") & ~F.rlike(F.substring(after_la, 2, 1), F.lit(word)), _option(after_la)),
        F.when((F.char_length(last) < 2) | ~F.rlike(F.substring(before_last, 1, 1), F.lit(word)), _option(F.substring(last, -1, 1))),
        F.nullif(F.substring(F.regexp_replace(t, "[^abcd]", ""), 1, 1), F.lit("")),
    )


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.char_length(c) / 4)


def question_list(c: Column, most: int) -> Column:
    """A JSON array of strings as an answer gives it, code fence or not, cut to ``most``; unreadable: empty."""
    bare = F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", "")
    return F.slice(F.coalesce(F.from_json(bare, "array<string>"), F.array().cast("array<string>")), 1, most)


def context_path(c: Column) -> Column:
    """An array of (type, name) from leaf to root as 'Type name > ...' from root to leaf, without the artificial nodes."""
    shown = F.filter(F.reverse(c), lambda x: ~F.upper(x["type"]).isin("ROOT", "CONTENT"))
    name = lambda x: F.when(F.upper(x["name"]) == x["name"], F.initcap(F.lower(x["name"]))).otherwise(x["name"])
    return F.array_join(F.transform(shown, lambda x: F.concat_ws(" ", F.initcap(x["type"]), name(x))), " > ")
