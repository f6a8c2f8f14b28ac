"""DuckDB SQL with the rows of those operators' queries that SQL can express."""

from __future__ import annotations

from lexlake.llm.quality import FINE, LEAST_DOCS, SYMBOLS
from lexlake.llm.quality import RULES as QUALITY
from lexlake.llm.secret_scan import BASE, RULES

_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(p.h), (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.h = f.h"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), u AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL"""


def _spans(place: int) -> str:
    """A list of (start, place, end, kind) of a rule's matches that count, in a text t."""
    rule = RULES[place]
    # maximal runs: asking for 24 digits at once finds the same spans as dropping shorter ones, only sooner
    # DuckDB's expressions know no possessive loops: those of the rules match as greedy ones do
    greedy = rule.pattern.replace("]++", "]+").replace("}+", "}").replace(")*+", ")*")
    pattern = "[0-9a-f]{24,}" if rule.kind == "hex" else greedy.replace("'", "''")
    hits = f"regexp_extract_all(t, '{pattern}')"
    sized = f"regexp_extract_all(t, '{pattern}', {rule.group})"
    gaps = f"regexp_split_to_array(t, '{pattern}')"
    start = "(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT"
    return f"""SELECT doc_id, unnest(list_filter(list_transform(range(1, len(h) + 1), lambda i: {{'s': {start}, 'p': {place}, 'e': {start} + length(h[i]), 'k': '{rule.kind}', 'n': length(z[i])}}), lambda x: x.n >= {rule.least})) AS x
      FROM (SELECT doc_id, {hits} AS h, {sized} AS z, {gaps} AS g FROM d)"""


_FOUND = " UNION ALL ".join(_spans(k) for k in range(len(RULES)))
_PLACES = len(BASE)
_SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS ({_FOUND}),
a AS (SELECT doc_id, count(*) FILTER (x.k = 'assign') AS n_assign, count(*) FILTER (x.k = 'access') AS n_access, count(*) FILTER (x.k = 'hex') AS n_hex,
  string_agg(x.k || ':' || x.s || ':' || x.e, ',' ORDER BY x.s, x.p) FILTER (x.p < {_PLACES}) AS base, string_agg(x.k || ':' || x.s || ':' || x.e, ',' ORDER BY x.s, x.p) AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""

_EDITS = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS o FROM documents)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(o, length(t) // 2)) AS edited_sha256 FROM d"""

_CHARS = """WITH h AS (SELECT coalesce(length(text), 0)::BIGINT AS n, count(*) AS docs FROM documents GROUP BY 1)
SELECT n AS n_tokens, docs, (sum(docs) OVER up)::BIGINT AS docs_from, (sum(docs * n) OVER up)::BIGINT AS tokens_from, (sum(docs) OVER ())::BIGINT AS docs_all, (sum(docs * n) OVER ())::BIGINT AS tokens_all,
  (sum(docs * n) OVER () - sum(docs * n) OVER up + n * sum(docs) OVER up)::BIGINT AS cut_tokens, (sum(docs) OVER () - sum(docs) OVER up)::DOUBLE / (sum(docs) OVER ())::DOUBLE AS share_below
FROM h WINDOW up AS (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""

# the level of all sources below their cap is the one at which targets add up: found by trying every source's own
_TARGETS = """WITH s AS (SELECT source, sum(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0))::BIGINT AS n FROM documents GROUP BY 1),
w AS (SELECT source, n, 3.0 * n AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
l AS (SELECT a.cap / a.w AS level, (SELECT sum(n) FROM s) AS total, sum(least(b.cap, b.w * a.cap / a.w)) AS at_level, sum(CASE WHEN b.cap / b.w <= a.cap / a.w THEN b.cap ELSE 0 END) AS capped, sum(CASE WHEN b.cap / b.w > a.cap / a.w THEN b.w ELSE 0 END) AS free FROM w a, w b GROUP BY a.source, a.cap, a.w),
b AS (SELECT coalesce(max_by((total - capped) / free, level), (SELECT sum(n) FROM s) / (SELECT sum(w) FROM w)) AS level FROM l WHERE at_level <= total AND free > 0)
SELECT source, n AS source_size, round(least(cap, w * level), 3) AS target FROM w, b"""

_BLANK = "[\\x20\\x09-\\x0D]"
_RULE_ROWS = ", ".join(f"({k}, {r.slack}, {r.spread}, {str(r.low).lower()})" for k, r in enumerate(QUALITY))
_VALUES = ", ".join(f"({r.scale} * {r.part}) // nullif({r.whole}, 0)" for r in QUALITY)
_SHIFT = f"greatest(0, length(bin(v)) - 1 - {FINE})"
_FLOOR = f"greatest(0, b // {2**FINE} - 1)"


def _quartiles(by: str) -> str:
    keys = f"{by}, " if by else ""
    least = ", ".join(f"min(b) FILTER (4 * upto >= {k} * every) AS b{k}" for k in (1, 3))
    floors = ", ".join(f"((b{k} - {_FLOOR.replace('b /', f'b{k} /')} * {2**FINE}) << ({_FLOOR.replace('b /', f'b{k} /')})::INT)::BIGINT AS q{k}" for k in (1, 3))
    return f"""SELECT {keys}rule, n, {floors} FROM (SELECT {keys}rule, max(every) AS n, {least} FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}rule ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys}rule) AS every
      FROM (SELECT {keys}rule, b, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL)"""


_QUALITY = f"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2), x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM v),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM x WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
c AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_BLANK}', '', 'g'))::BIGINT AS word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
e AS (SELECT *, [{_VALUES}] AS vs FROM c), rules(rule, slack, spread, low) AS (VALUES {_RULE_ROWS}),
vals AS (SELECT doc_id, lang, source, unnest(vs) AS v, unnest(range(len(vs))) AS rule FROM e),
sketch AS (SELECT lang, source, rule, {_SHIFT} * {2**FINE} + (v >> ({_SHIFT})::INT) AS b, count(*) AS n FROM vals WHERE v IS NOT NULL GROUP BY ALL),
f AS ({_quartiles("lang, source")}), m AS ({_quartiles("lang")}), a AS ({_quartiles("")}),
q AS (SELECT f.lang, f.source, f.rule, CASE WHEN f.n >= {LEAST_DOCS} THEN f.q1 WHEN m.n >= {LEAST_DOCS} THEN m.q1 ELSE a.q1 END AS q1, CASE WHEN f.n >= {LEAST_DOCS} THEN f.q3 WHEN m.n >= {LEAST_DOCS} THEN m.q3 ELSE a.q3 END AS q3
  FROM f JOIN m ON f.lang IS NOT DISTINCT FROM m.lang AND f.rule = m.rule JOIN a ON a.rule = f.rule),
cuts AS (SELECT lang, source, rule, q3 + greatest(spread * (q3 - q1), slack) AS high, CASE WHEN low THEN q1 - greatest(spread * (q3 - q1), slack) END AS low FROM q JOIN rules USING (rule)),
bad AS (SELECT vals.doc_id, list(vals.rule ORDER BY vals.rule) AS rules FROM vals JOIN cuts ON vals.rule = cuts.rule AND vals.lang IS NOT DISTINCT FROM cuts.lang AND vals.source IS NOT DISTINCT FROM cuts.source WHERE v > high OR v < low GROUP BY vals.doc_id),
z AS (SELECT e.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(array_to_string(list_transform(rules, lambda k: {[r.name for r in QUALITY]}[k + 1]), ','), '') AS failed_rules FROM e LEFT JOIN bad USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM z"""

_H = " || ".join("coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')".format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{t}"))
_CRC_ROW = "k"
for _ in range(8):
    _CRC_ROW = f"(SELECT i, xor(k >> 1, (k & 1) * 3988292384) AS k FROM {_CRC_ROW if _CRC_ROW != 'k' else '(SELECT i, i AS k FROM range(256) r(i))'})"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"
_DEPTH, _TOP = 7, 4


def _tree(name: str, keys: str, depth: int) -> str:
    """Levels name0 (given: keys, i, h, n) to name{depth}, and the steps of each level's nodes."""
    out = []
    for k in range(depth):
        run = f"PARTITION BY {keys}, i // 16 ORDER BY i ROWS BETWEEN"
        out.append(f"{name}{k + 1} AS (SELECT {keys}, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (max(n) + 15) // 16 AS n FROM {name}{k} WHERE n > 1 GROUP BY {keys}, i // 16)")
        out.append(f"{name}s{k} AS (SELECT {keys}, i, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1)")
    return ", ".join(out)


def _walk(source: str, name: str, keys: str, at: str, depth: int, out: str) -> str:
    """``source`` with its path p and fold f carried on through the steps of name0 to name{depth - 1}."""
    steps = []
    for k in range(depth):
        steps.append(f"{out}{k} AS (SELECT a.* REPLACE (p || coalesce(l || r, '') AS p, CASE WHEN l IS NULL THEN f ELSE sha256(l || f || r) END AS f) FROM {source if k == 0 else f'{out}{k - 1}'} a LEFT JOIN {name}s{k} b ON a.{keys} IS NOT DISTINCT FROM b.{keys} AND b.i = {at} // {16**k})")
    return ", ".join(steps)


_MERKLE = f"""WITH c AS (SELECT list(k ORDER BY i) AS t FROM {_CRC_ROW}),
d AS (SELECT doc_id, source, sha256({_H.format(t="text")}) AS h, CASE WHEN {_CRC} % 5 = 0 THEN sha256({_H.format(t=f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS g FROM documents, c),
e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
n0 AS (SELECT source, i, h, n FROM e), {_tree("n", "source", _DEPTH)},
r AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM ({" UNION ALL ".join(f"SELECT source, h FROM n{k} WHERE n = 1" for k in range(_DEPTH + 1))})),
u0 AS (SELECT 0 AS z, i, h, n FROM r), {_tree("u", "z", _TOP)}, root AS ({" UNION ALL ".join(f"SELECT h AS root FROM u{k} WHERE n = 1" for k in range(_TOP + 1))}),
w AS (SELECT doc_id, source, h AS leaf, i AS at, '' AS p, coalesce(g, h) AS f FROM e), {_walk("w", "n", "source", "a.at", _DEPTH, "w")},
x AS (SELECT w{_DEPTH - 1}.*, r.h AS subroot, 0 AS z, r.i AS up FROM w{_DEPTH - 1} JOIN r ON r.source IS NOT DISTINCT FROM w{_DEPTH - 1}.source), {_walk("x", "u", "z", "a.up", _TOP, "x")}
SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM x{_TOP - 1}, root"""

SQL = {"op11_merkle": _MERKLE, "op13_quality": _QUALITY, "op2_secrets": _SECRETS, "op5_warc": _WARC, "op6_ngram_join": _JOIN, "fingerprint_edits": _EDITS, "char_counts": _CHARS, "mix_targets": _TARGETS}
