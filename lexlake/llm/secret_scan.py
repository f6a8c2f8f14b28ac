"""Secret scans over a trigram inverted index, as DataFrame operations.

From each rule's regular expression a Boolean query over trigrams is derived: an OR of ANDs that
every match must satisfy. The index lists, for each trigram that some query names, the texts that
hold it, in blocks of bounded size. Postings are intersected within a block, the survivors are
united per text, and only those are verified with the regular expression. A rule whose
expression has no mandatory trigrams scans every text.

The index knows texts by a 64-bit hash: copies share one posting, and two texts with one hash at
worst cost a verification. Trigrams are of the lower-cased text, so rules may ignore case.

Defined results: a null text is as an empty one and has no spans; repeated rows are scanned each;
an empty table gives an empty result; extra columns stay as they are (``scan`` replaces one named spans).
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import BROADCAST_ROWS, fresh, let, small, written

Query = frozenset[frozenset[str]]


@dataclass(frozen=True)
class Rule:
    """``pattern`` holds in Python's and Java's syntax; a match counts if group ``group`` has
    ``least`` characters. Matches are leftmost, not overlapping; those that fail are dropped.
    ``screen`` matches every text with a match that counts; without one, ``pattern`` does."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    screen: str | None = None


#: The three base rules come first; spans at one start are listed in this order.
RULES: tuple[Rule, ...] = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
    # all up to the closing line, which is the next run of five dashes; else the lines of base64 that follow. Loops over groups
    # are possessive: Java's matcher goes round those in place, others by recursion, and a key may have any number of lines
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]++|-{1,4}[^-])*+-----END [A-Z ]*PRIVATE KEY-----|(?:[\x0A\x0D]++[A-Za-z0-9+/=]{16,}+)*+)",
        screen=r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    ),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("prefixed", r"(gh[pousr]_|sk_live_|sk_test_|xox[abp]-)[A-Za-z0-9_-]{16,}"),
)
BASE = ("assign", "access", "hex")
#: Tasks that the copies of one text are spread over where candidates are joined by shuffle.
SALTS = 16


def _exact(nodes, most: int = 64) -> tuple[set[str] | None, Query | None]:
    """Of a parsed expression: the strings it can match (None: not so few), and what its matches must hold (None: nothing)."""
    strings: set[str] | None = {""}
    whole, need = True, None

    def flush() -> None:
        nonlocal strings, need
        need = _both(need, _of_strings(strings))
        strings = {""}

    for op, arg in nodes:
        if op is sre.LITERAL:
            part, inner = {chr(arg).lower()}, None
        elif op is sre.IN:
            part, inner = _class(arg, most), None
        elif op is sre.SUBPATTERN:
            part, inner = _exact(arg[-1], most)
        elif op is sre.BRANCH:
            found = [_exact(x, most) for x in arg[1]]
            part = set().union(*(s for s, _ in found)) if all(s is not None for s, _ in found) else None
            wants = [q if s is None else _of_strings(s) for s, q in found]
            inner = _least(frozenset().union(*wants)) if all(wants) else None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            part, inner = _exact(body, most)
            once = inner if part is None else _of_strings(part)
            if part is not None and high <= 1:
                part = part | {""} if low == 0 else part
                inner = None
            else:
                part, inner = None, once if low else None
        else:
            part, inner = None, None
        if part is None or len(part) * len(strings) > most:
            flush()
            whole = False
            need = _both(need, inner)
            strings = part if part is not None else {""}
        else:
            strings = {a + b for a in strings for b in part}
    if whole:
        return strings, None
    flush()
    return None, need


def _class(items, most: int) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            found.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < most:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= 4 else None


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _of_strings(strings: set[str] | None) -> Query | None:
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return _least(frozenset(map(_trigrams, strings)))


def _least(q: Query) -> Query:
    return frozenset(a for a in q if not any(b < a for b in q))


def _both(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return a or b
    return _least(frozenset(x | y for x in a for y in b)) if len(a) * len(b) <= 256 else a


def trigram_query(pattern: str) -> Query | None:
    """An OR of ANDs of lower-case trigrams that every match of ``pattern`` holds; None: it has no such."""
    strings, need = _exact(sre_parser.parse(pattern))
    return need if strings is None else _of_strings(strings)


def content_key(text: Column) -> Column:
    """The name of a text in the index."""
    return F.xxhash64(text)


def any_trigram(trigrams: list[str]) -> str:
    """A look-ahead that captures, at every place, which of the trigrams begins there; those of one first letter are one branch."""
    by_first: dict[str, list[str]] = {}
    for t in trigrams:
        by_first.setdefault(t[0], []).append(re.escape(t[1:]))
    return "(?=(" + "|".join(f"{re.escape(a)}(?:{'|'.join(rest)})" for a, rest in sorted(by_first.items())) + "))"


def postings(docs: DataFrame, trigrams: list[str], block_texts: int = 4096) -> DataFrame:
    """The index: (block, trigram, texts), ``texts`` the keys of the distinct texts of a block with that trigram.

    Blocks are hash classes of the keys, about ``block_texts`` rows each, so no posting outgrows a task.
    """
    blocks = max(1, docs.count() // block_texts)
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(any_trigram(trigrams)), F.lit(1)))
    rows = docs.select(content_key(F.col("text")).alias("key"), F.explode(held).alias("trigram"))
    rows = rows.withColumn("block", F.pmod("key", F.lit(blocks)))
    return rows.groupBy("block", "trigram").agg(F.collect_set("key").alias("texts"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """key and kinds: the texts that some query's postings leave, and the kinds to verify."""
    per_block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "texts"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def found(query: Query) -> Column:
        alternatives = []
        for clause in sorted(map(sorted, query)):
            texts = F.coalesce(F.col("lists")[clause[0]], none)
            for t in clause[1:]:
                texts = F.array_intersect(texts, F.coalesce(F.col("lists")[t], none))
            alternatives.append(texts)
        both = alternatives[0]
        for x in alternatives[1:]:
            both = F.array_union(both, x)
        return both

    each = F.array(*[F.struct(F.lit(kind).alias("kind"), found(q).alias("texts")) for kind, q in sorted(queries.items())])
    rows = per_block.select(F.explode(each).alias("_e")).select("_e.kind", F.explode("_e.texts").alias("key"))
    return rows.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def rule_spans(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, place, end, kind>> of a rule's matches: code points, end exclusive.

    Between the pieces that a split at the pattern leaves lie its matches; a fold adds up lengths.
    """
    pattern = F.lit(rule.pattern)
    empty = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length) if rule.group else F.transform(hits, F.char_length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    rows = F.zip_with(F.zip_with(gaps, F.transform(hits, F.char_length), lambda g, m: F.struct(g.alias("g"), m.alias("m"))), sized, lambda x, n: F.struct(x["g"].alias("g"), x["m"].alias("m"), n.alias("n")))
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + F.coalesce(x["m"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = F.when(x["n"] >= rule.least, F.array(span)).otherwise(empty)
        return F.struct(end.alias("at"), F.concat(acc["found"], keep).alias("found"))

    return F.when(F.rlike(text, F.lit(rule.screen or rule.pattern)), F.aggregate(rows, start, step, lambda acc: acc["found"])).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``spans``: array<struct<start, place, end, kind>> by start, then the rules' order.

    The index and its candidates come from one pass over the texts; the candidates, few and
    slim, are written to the shared folder. If they are few enough they are broadcast, else joined by shuffle, each
    text's rows (copies, empty ones) spread over ``SALTS`` tasks by their other columns.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    text = F.coalesce(F.col("text"), F.lit(""))
    key, there, kinds, salt, its_salt = fresh(docs, "text_key", "candidate_key", "candidate_kinds", "text_salt", "candidate_salt")
    if queries:
        index = postings(docs, sorted({t for q in queries.values() for c in q for t in c}))
        picked = written(candidates(index, queries), "secret-candidates")
        n = picked.count()
        picked = picked.toDF(there, kinds)
        docs = docs.withColumn(key, content_key(F.col("text")))
        same = F.col(key) == F.col(there)
        if n > BROADCAST_ROWS:
            simple = [c for c, t in docs.dtypes if t in ("string", "bigint", "int", "double", "date", "timestamp") and c not in ("text", key)]
            docs = docs.withColumn(salt, F.pmod(F.xxhash64(*simple), F.lit(SALTS)))
            picked = picked.withColumn(its_salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            same &= F.col(salt) == F.col(its_salt)
        docs = docs.join(small(picked, n), same, "left").drop(key, there, salt, its_salt)
    else:
        docs = docs.withColumn(kinds, F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    found = []
    for place, rule in enumerate(rules):
        spans = rule_spans(text, rule, place)
        found.append(F.when(F.array_contains(kinds, rule.kind), spans).otherwise(empty) if rule.kind in queries else spans)
    return docs.withColumn("spans", F.sort_array(F.concat(*found))).drop(kinds)


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, digest and list of every text's spans."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark`` (overlapping spans: one mark), n_chars to match.

    Columns and rows stay; a null text stays null.
    """
    columns = docs.columns
    (users,) = fresh(docs, "own_spans")
    found = scan(docs.withColumnRenamed("spans", users), rules)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], between, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))))
    found = found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.char_length("text").cast("long"))
    return found.select(*[F.col(users).alias(c) if c.lower() == "spans" else c for c in columns])
