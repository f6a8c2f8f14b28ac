"""Queries that read legal text: a law, sentences, an answer or an exam made for every row of a table, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.functions import citations as cites
from lexlake.operators import batches, exams, law_tree, linking
from lexlake.plans.catalogue import query, table
from lexlake.session import partitions, written
from lexlake.sources import laws

# A law for every customer: its titles, chapters, articles, versions, paragraphs, letters, tables and repeals are so many, and say what they say, by the
# customer's key (c). The law is written as XML in Spark; SQL states from the same numbers what must come out of it.
_TITLES, _CHAPTERS, _EACH = "(1 + c % 2)", "(1 + c DIV 2 % 2)", "(1 + c % 3)"


def _element(name: str, body: str, attributes: str = "''") -> str:
    return f"concat('<{name}', {attributes}, '>', {body}, '</{name}>')"


def _each(n: str, name: str, body: str, most: int = 3) -> str:
    """Bodies for ``name`` from 1 to n (at most ``most``), on end."""
    return f"array_join(transform(filter(sequence(1, {most}), {name} -> {name} <= {n}), {name} -> {body}), '')"


def _law_xml() -> str:
    letters = _each("(c + p) % 3", "q", _element("p", "concat(substr('abc', q, 1), ') Caso ', a + q + v * (q - 1))"))
    cited = "concat(' conforme al artículo ', 1 + (c + 2 * a) % n, ' de esta ley', if((c + a) % 6 = 0, ' y al art. 14 CE.', '.'))"
    paragraph = "concat(" + _element("p", f"concat(p, '. Regla ', c % 89 + a + v * (p % 2), if(p = 1, {cited}, '.'))") + f", {letters})"
    cell = lambda x: _element("td", x)
    rows = _element("tr", "concat(" + cell("'<p>Concepto</p>'") + ", " + cell("'<p>Euros</p>'") + ")") + ", " + _element("tr", "concat(" + cell("concat('Item ', a)") + ", " + cell("if(v = 0, '', concat(v * 100 + a))") + ")")
    table_ = f"if((c + a) % 4 = 0, {_element('table', f'concat({rows})')}, '')"
    title = "concat('Artículo ', a, if((c + a) % 5 = 0, ' bis', ''), '. Objeto ', c % 97 + a, '.')"
    day = "date_format(date_add(date'1990-01-01', cast(c % 3000 + 400 * v as int)), 'yyyyMMdd')"
    version = _element("version", f"concat({_element('p', title)}, {_each('1 + (c + a + v) % 3', 'p', paragraph)}, {table_})", f"concat(' id_norma=\"N', v, '\" fecha_vigencia=\"', {day}, '\"')")
    version = f"array_join(transform(sequence(0, (c + a) % 3), v -> {version}), '')"

    def block(id_: str, kind: str, title: str, body: str) -> str:
        return _element("bloque", body, f"concat(' id=\"', {id_}, '\" tipo=\"{kind}\" titulo=\"', {title}, '\"')")

    def heading(id_: str, text: str) -> str:
        return block(id_, "encabezado", text, _element("version", _element("p", text), "' id_norma=\"N0\" fecha_vigencia=\"19900101\"'"))

    roman = lambda k: f"repeat('I', {k})"
    article = block("concat('a', a)", "precepto", "concat('Artículo ', a)", version)
    number = f"((t - 1) * {_CHAPTERS} + k - 1) * {_EACH} + i"
    articles = _each(_EACH, "i", f"array_join(transform(array({number}), a -> {article}), '')")
    chapters = _each(_CHAPTERS, "k", f"concat({heading("concat('c', t, k)", f"concat('CAPÍTULO ', {roman('k')})")}, {articles})")
    titles = _each(_TITLES, "t", f"concat({heading("concat('t', t)", f"concat('TÍTULO ', {roman('t')})")}, {chapters})")
    several = "concat('Artículos 1 ', if(c % 8 = 0, 'a ', 'y '), least(n, 3))"
    repeal = block("'r'", "precepto", several, _element("version", f"concat({_element('p', several)}, '<p>(Derogado)</p>')", "' id_norma=\"N9\" fecha_vigencia=\"20300101\"'"))
    signed = block("'f'", "firma", "''", _element("version", "'<p>Firmado</p>'", "''"))
    meta = "concat('<metadatos><identificador>L', c, '</identificador><titulo>Ley ', c, '</titulo><fecha_vigencia>', date_format(date_add(date'1990-01-01', cast(c % 3000 as int)), 'yyyyMMdd'), '</fecha_vigencia></metadatos><analisis><materias><materia>M', c % 7, '</materia><materia>M', c % 11 + 7, '</materia></materias></analisis>')"
    return f"concat('<response><data>', {meta}, '<texto>', {titles}, if(c % 4 = 0 and n > 1, {repeal}, ''), {signed}, '</texto></data></response>')"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, dealt to all cores, 4 096 to a task at most: a few bytes of each become a text that Python reads."""
    rows = table(spark, sf_dir, "customer")
    return rows.repartition(partitions(spark, rows.count(), 4096), "c_custkey")


def _laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """law_id and xml of every customer's law."""
    numbers = _customers(spark, sf_dir).select(F.col("c_custkey").alias("c")).withColumn("n", F.expr(f"{_TITLES} * {_CHAPTERS} * {_EACH}"))
    return numbers.select(F.concat(F.lit("L"), "c").alias("law_id"), F.expr(_law_xml()).alias("xml"))


def _law_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laws.law_lines(_laws(spark, sf_dir))


#: The same laws in SQL: articles (ar), versions with their validity (ve), lines below articles (li) with kind, marks and depth.
_SQL_LAWS = """cu AS (SELECT c_custkey AS c, 1 + c_custkey % 2 AS nt, 1 + c_custkey // 2 % 2 AS nk, 1 + c_custkey % 3 AS na, (1 + c_custkey % 2) * (1 + c_custkey // 2 % 2) * (1 + c_custkey % 3) AS n FROM customer),
ar AS (SELECT *, ((t - 1) * nk + k - 1) * na + i AS a, 1 + (c + ((t - 1) * nk + k - 1) * na + i) % 3 AS nv, (c + ((t - 1) * nk + k - 1) * na + i) % 5 = 0 AS bis FROM (SELECT *, unnest(range(1, na + 1)) AS i FROM (SELECT *, unnest(range(1, nk + 1)) AS k FROM (SELECT *, unnest(range(1, nt + 1)) AS t FROM cu)))),
v0 AS (SELECT *, false AS gone, (DATE '1990-01-01' + (c % 3000 + 400 * v)::INT)::DATE AS since FROM (SELECT *, unnest(range(nv)) AS v FROM ar)
  UNION ALL SELECT *, nv AS v, true, DATE '2030-01-01' FROM ar WHERE c % 4 = 0 AND n > 1 AND (a = 1 OR a = least(n, 3) OR c % 8 = 0 AND a <= 3)),
ve AS (SELECT *, 'L' || c || '_a' || a || '_' || v AS id, lead('L' || c || '_a' || a || '_' || v) OVER (PARTITION BY c, a ORDER BY v) AS next_id, lead(since) OVER (PARTITION BY c, a ORDER BY v) AS until,
  'Artículo ' || a || CASE WHEN gone THEN '' ELSE CASE WHEN bis THEN ' bis' ELSE '' END || '. Objeto ' || (c % 97 + a) || '.' END AS name, a || CASE WHEN bis AND NOT gone THEN ' bis' ELSE '' END AS num FROM v0),
pa AS (SELECT ve.*, unnest(range(1, 2 + (c + a + v) % 3)) AS p, 1 + (c + a + v) % 3 AS np FROM ve WHERE NOT gone),
le AS (SELECT *, unnest(range(1, 1 + (c + p) % 3)) AS q FROM pa),
l0 AS (SELECT c, a, v, id, next_id, p, 0 AS q, 'apartado_numerico' AS kind, 1 AS depth, p || '.' AS mark, '' AS up, '' AS above, p || '. Regla ' || (c % 89 + a + v * (p % 2)) || CASE WHEN p = 1 THEN ' conforme al artículo ' || (1 + (c + 2 * a) % n) || ' de esta ley' || CASE WHEN (c + a) % 6 = 0 THEN ' y al art. 14 CE.' ELSE '.' END ELSE '.' END AS text FROM pa
  UNION ALL SELECT c, a, v, id, next_id, p, q, 'apartado_alfa', 2, substr('abc', q::INT, 1) || ')', p || '.', p || '.', substr('abc', q::INT, 1) || ') Caso ' || (a + q + v * (q - 1)) FROM le
  UNION ALL SELECT c, a, v, id, next_id, np, 9, 'table', CASE WHEN (c + np) % 3 > 0 THEN 3 ELSE 2 END, '1', CASE WHEN (c + np) % 3 > 0 THEN substr('abc', ((c + np) % 3)::INT, 1) || ')' ELSE np || '.' END, np || '.' || CASE WHEN (c + np) % 3 > 0 THEN substr('abc', ((c + np) % 3)::INT, 1) ELSE '' END,
    '| Concepto | Euros |' || chr(10) || '|---|---|' || chr(10) || '| Item ' || a || ' | ' || CASE WHEN v = 0 THEN '-' ELSE (v * 100 + a)::VARCHAR END || ' |' FROM pa WHERE p = np AND (c + a) % 4 = 0
  UNION ALL SELECT c, a, v, id, next_id, 1, 0, 'parrafo', 1, '1', '', '', '(Derogado)' FROM ve WHERE gone),
li AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, q) AS line FROM l0)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return law_tree.article_versions(law_tree.distributed(_law_lines(spark, sf_dir)))


def _elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Elements and article versions of every law, both from lines that are parsed once."""
    lines = law_tree.distributed(_law_lines(spark, sf_dir))
    return law_tree.elements(lines), law_tree.article_versions(lines)


@query(f"""WITH {_SQL_LAWS} SELECT id AS article_id, name, num AS clean_number, 'Título I' || repeat('i', (t - 1)::INT) || ', Capítulo I' || repeat('i', (k - 1)::INT) AS path, strftime(since, '%Y-%m-%d') AS valid_from, strftime(until, '%Y-%m-%d') AS valid_to FROM ve""")
def law_tree_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article versions of every customer's law in XML: structure, numbers, validity; a compound block is shared out."""
    day = lambda c: F.to_date(c).cast("string").alias(c)
    return _versions(spark, sf_dir).select("article_id", "name", "clean_number", "path", day("valid_from"), day("valid_to"))


@query(f"WITH {_SQL_LAWS} SELECT id AS article_id, string_agg(text, chr(10) || chr(10) ORDER BY line) AS full_text FROM li GROUP BY id")
def article_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full texts of the article versions of every customer's law, tables included."""
    return _versions(spark, sf_dir).select("article_id", "full_text")


@query(f"WITH {_SQL_LAWS} SELECT id AS article_id, string_agg(repeat('  ', depth - 1) || text, chr(10) ORDER BY line) AS rich_text FROM li GROUP BY id")
def rich_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the article versions of every customer's law, indented by depth."""
    return law_tree.indented_text(law_tree.elements(law_tree.distributed(_law_lines(spark, sf_dir))))


@query(f"""WITH {_SQL_LAWS}, pr AS (SELECT id AS old_id, next_id AS new_id FROM ve WHERE next_id IS NOT NULL),
  o AS (SELECT pr.*, kind, above, up, mark, text FROM pr JOIN li ON li.id = old_id), w AS (SELECT pr.*, kind, above, up, mark, text FROM pr JOIN li ON li.id = new_id),
  x AS (SELECT coalesce(o.old_id, w.old_id) AS old_id, coalesce(o.new_id, w.new_id) AS new_id, coalesce(o.kind, w.kind) AS node_type, coalesce(o.up, w.up) AS up, coalesce(o.mark, w.mark) AS mark,
    CASE WHEN o.text IS NULL THEN 'added' WHEN w.text IS NULL THEN 'removed' WHEN o.text <> w.text THEN 'modified' END AS change FROM o FULL JOIN w ON o.old_id = w.old_id AND o.kind = w.kind AND o.above = w.above AND o.mark = w.mark)
  SELECT old_id, new_id, node_type, CASE WHEN up = '' THEN mark ELSE up || ' ' || mark END AS name, change FROM x WHERE change IS NOT NULL""")
def element_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that the next version of an article adds, removes or alters, in every customer's law, found below digests that differ."""
    return law_tree.element_changes(*_elements(spark, sf_dir))


@query(f"""WITH {_SQL_LAWS}, g1 AS (SELECT id, next_id, p, string_agg(kind || mark || text, '|' ORDER BY line) AS s, count(*) AS n FROM li GROUP BY id, next_id, p),
  e1 AS (SELECT o.id AS old_id, o.next_id AS new_id, o.p AS p, o.n AS n FROM g1 o JOIN g1 w ON w.id = o.next_id AND w.p = o.p AND w.s = o.s),
  g2 AS (SELECT l.id, l.next_id, l.p, l.q, l.text || coalesce(t.text, '') AS s, 1 + (t.text IS NOT NULL)::INT AS n FROM li l LEFT JOIN li t ON t.id = l.id AND t.p = l.p AND t.kind = 'table' AND t.depth = 3 AND l.q = (l.c + l.p) % 3 WHERE l.kind = 'apartado_alfa'),
  e2 AS (SELECT o.id AS old_id, o.next_id AS new_id, o.p AS p, o.q AS q, o.n AS n FROM g2 o JOIN g2 w ON w.id = o.next_id AND w.p = o.p AND w.q = o.q AND w.s = o.s ANTI JOIN e1 ON e1.old_id = o.id AND e1.p = o.p),
  e3 AS (SELECT o.id AS old_id, o.next_id AS new_id, 1 AS n FROM li o JOIN li w ON w.id = o.next_id AND w.kind = 'table' AND w.above = o.above AND w.text = o.text ANTI JOIN e1 ON e1.old_id = o.id AND e1.p = o.p
    ANTI JOIN e2 ON e2.old_id = o.id AND e2.p = o.p AND o.depth = 3 AND e2.q = (o.c + o.p) % 3 WHERE o.kind = 'table')
  SELECT old_id, new_id, sum(n)::BIGINT AS pruned FROM (SELECT old_id, new_id, n FROM e1 UNION ALL SELECT old_id, new_id, n FROM e2 UNION ALL SELECT old_id, new_id, n FROM e3) GROUP BY ALL""")
def element_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of each pair of versions that were not compared, as a digest above them was equal."""
    return law_tree.compared(*_elements(spark, sf_dir))[1]


@query(f"WITH {_SQL_LAWS} SELECT id AS src, 'PART_OF' AS rel, 'L' || c AS dst FROM ve UNION ALL SELECT id, 'NEXT_VERSION', next_id FROM ve WHERE next_id IS NOT NULL")
def law_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the articles of every customer's law."""
    return law_tree.graph_rows(_versions(spark, sf_dir))[1].filter("rel <> 'PREVIOUS_VERSION'")


@query(f"""WITH {_SQL_LAWS}, x AS (SELECT ve.*, 1 + (c + 2 * a) % n AS x FROM ve WHERE NOT gone),
  r AS (SELECT x.id AS src, coalesce('L' || x.c || '_a' || y.a || '_' || least(x.v, y.nv - 1), 'L' || x.c) AS dst FROM x LEFT JOIN ar y ON y.c = x.c AND y.a = x.x AND NOT y.bis)
  SELECT DISTINCT src, 'REFERS_TO' AS rel, dst FROM r WHERE src <> dst UNION ALL SELECT id, 'REFERS_TO', 'BOE-A-1978-31229_14' FROM ve WHERE NOT gone AND (c + a) % 6 = 0""")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations as edges: to the article in force, or to the law where there is no such article."""
    own = _versions(spark, sf_dir).select("article_id", "law_id", "clean_number", "full_text", "valid_from", "valid_to")
    own = written(own, "law-articles")
    other = spark.createDataFrame([("BOE-A-1978-31229_14", "BOE-A-1978-31229", "14", "")], "article_id string, law_id string, clean_number string, full_text string")
    both = own.unionByName(other.withColumns({"valid_from": F.lit("1978-12-29").cast("timestamp_ntz"), "valid_to": F.lit(None).cast("timestamp_ntz")}))
    return linking.linked(written(linking.extracted(own), "law-citations"), both).select("src", "rel", "dst")


_SQL_TREE = _SQL_LAWS + """,
nd AS (SELECT 'L' || c AS id, 'normativa' AS label, 'L' || c AS name, NULL AS up, c, 0 AS t, 0 AS k, 0 AS a, -1 AS v, 0 AS line FROM cu
  UNION ALL SELECT id, 'articulo', name, 'L' || c, c, t, k, a, v, 0 FROM ve
  UNION ALL SELECT li.id || '#' || (CASE WHEN kind = 'parrafo' THEN 1 ELSE line END), kind, text, CASE WHEN up = '' THEN li.id ELSE NULL END, li.c, ve.t, ve.k, li.a, li.v, line FROM li JOIN ve ON ve.id = li.id)"""


@query(f"WITH {_SQL_TREE} SELECT label AS name, 'node' AS kind, count(*) AS n FROM nd GROUP BY label UNION ALL SELECT 'PART_OF', 'edge', count(*) FROM nd WHERE label <> 'normativa'")
def saved_law_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by label and edges by relation of all laws as saved."""
    return law_tree.saved_counts(law_tree.distributed(_law_lines(spark, sf_dir)))


@query(f"""WITH {_SQL_TREE}, s AS (SELECT id, label, c, t, k, a, v, line FROM nd UNION ALL SELECT 'h', 'titulo', c, t, 0, 0, -1, 0 FROM (SELECT DISTINCT c, t FROM ar) UNION ALL SELECT 'h', 'capitulo', c, t, k, 0, -1, 0 FROM (SELECT DISTINCT c, t, k FROM ar)),
  n AS (SELECT id, label, 'L' || c || '_' || (row_number() OVER (PARTITION BY c ORDER BY t, k, a, v, line) - 1) AS seq_id FROM s) SELECT id, label, seq_id FROM n WHERE id <> 'h'""")
def saved_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all laws as saved, with their numbers in reading order."""
    return law_tree.saved_graph(law_tree.distributed(_law_lines(spark, sf_dir)))[0].select("id", "label", "seq_id")


@query(f"""WITH {_SQL_TREE}, e AS (SELECT id, up, c FROM nd WHERE label <> 'normativa'),
  x AS (SELECT li.id || '#' || line AS id, li.id || '#' || max(CASE WHEN kind = 'apartado_numerico' THEN line END) OVER w AS num, li.id || '#' || max(CASE WHEN kind = 'apartado_alfa' THEN line END) OVER w AS alfa, kind, depth FROM li WINDOW w AS (PARTITION BY li.id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT e.id AS src, 'PART_OF' AS rel, coalesce(e.up, CASE WHEN x.depth = 3 THEN x.alfa ELSE x.num END) AS dst FROM e LEFT JOIN x ON x.id = e.id""")
def saved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all laws as saved: elements to elements or articles, articles to laws, no headings."""
    return law_tree.saved_graph(law_tree.distributed(_law_lines(spark, sf_dir)))[1]


_N, _M = "(1 + c % 400)", "(1 + c % 37)"
#: Sentences by the customer's key: as a Spark expression, and the rows (kind, article, law) that come of them in SQL.
SENTENCES = [
    (f"concat('Según el artículo ', {_N}, ' de la Constitución Española, todos son iguales.')", [("constitution", _N, "'BOE-A-1978-31229'")]),
    (f"concat('El artículo ', {_N}, ' del Código Civil regula.')", [("code", _N, "'BOE-A-1889-4763'")]),
    (f"concat('De conformidad con el art. ', {_N}, ' CE y art. ', {_M}, ' CC.')", [("abbreviated", _N, "'BOE-A-1978-31229'"), ("abbreviated", _M, "'BOE-A-1889-4763'")]),
    (f"concat('La Ley Orgánica ', {_N}, '/2031, de 23 de noviembre, aprueba.')", [("organic_law", None, None)]),
    (f"concat('Como en el artículo anterior, y salvo lo del artículo ', {_N}, ' de esta ley.')", [("internal", f"({_M} + 1)", "'S'"), ("internal", _N, "'S'")]),
    (f"concat('Los artículos ', {_M}, ' a ', {_M} + {_N}, ' de esta Ley son básicos.')", [("internal", None, "'S'")]),
    (f"concat('Según la STC ', {_N}, '/2020, de 3 de marzo, y la STS ', {_M}, '/2019.')", [("judicial", None, None)] * 2),
    (f"concat('según el artículo ', {_N}, ' de la Ley ', {_M}, '/2031')", [("law", _N, None)]),
    ("concat('Conforme a la LOPJ y al ET, caso ', c, '.')", [("abbreviated", None, "'BOE-A-1985-12666'"), ("abbreviated", None, "'BOE-A-2015-11430'")]),
    (f"concat('La Directiva 2006/', {_N}, '/CE y el Reglamento (UE) 2016/', {_M}, ' obligan.')", [("eu_legislation", None, None)] * 2),
    (f"concat('Según la Ley ', {_N}, '/2099 y la Ley 39/2015.')", [("law", None, None), ("law", None, "'BOE-A-2015-10565'")]),
    (f"concat('el artículo 1.', lpad({_N}, 3, '0'), ' de la LEC')", [("abbreviated", f"(1000 + {_N})", "'BOE-A-2000-323'")]),
    (f"concat('Los arts. ', {_N}, ', ', {_N} + 1, ' y ', {_N} + 3, ' de la LOPJ.')", [("abbreviated", f"({_N} + {k})", "'BOE-A-1985-12666'") for k in (0, 1, 3)]),
    ("concat('Nada que citar en ', c, ' palabras.')", []),
    (f"concat('Ni el artículo ', {_N}, ' del Estatuto de Autonomía de Cataluña ni el Estatuto del País Vasco ni el de los Trabajadores.')", [("statute_of_autonomy", _N, None), ("statute_of_autonomy", None, None)]),
]
_REFS = " UNION ALL ".join(f"SELECT c AS c_custkey, '{kind}' AS kind, {f'{article}::VARCHAR' if article else 'NULL'} AS article, {law or 'NULL'} AS law FROM k WHERE c % {len(SENTENCES)} = {i}" for i, (_, rows) in enumerate(SENTENCES) for kind, article, law in rows)


@query(f"WITH k AS (SELECT c_custkey AS c FROM customer) {_REFS}")
def refs_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of sentences, one for every customer, with their kind, article and law."""
    sentence = F.expr(f"element_at(array({', '.join(x for x, _ in SENTENCES)}), cast(c % {len(SENTENCES)} as int) + 1)")
    rows = _customers(spark, sf_dir).select(F.col("c_custkey").alias("c"))
    own = F.expr(f"cast({_M} + 2 as string)")
    rows = rows.select(F.lit("S").alias("law_id"), own.alias("clean_number"), sentence.alias("full_text"), F.col("c").cast("string").alias("article_id"), F.lit(None).cast("timestamp_ntz").alias("valid_from"))
    found = linking.extracted(rows)
    return found.select(F.col("article_id").cast("long").alias("c_custkey"), F.col("reference_type").alias("kind"), F.col("target_number").alias("article"), F.col("target_law").alias("law"))


@query("""WITH u AS (SELECT c_custkey AS id, unnest(range(1, 2 + c_custkey % 4)) AS i, 1 + c_custkey % 4 AS n FROM customer)
  SELECT id, 'art_' || i || '_' || id % 50 || '_ce' AS key, CASE WHEN id % 2 = 0 THEN i ELSE n + 1 - i END AS place FROM u""")
def cite_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that an answer, one for every customer, cites, known ones only, at their first use."""
    keys = F.expr("transform(sequence(1, 1 + id % 4), i -> concat('art_', i, '_', id % 50, '_ce'))")
    customers = _customers(spark, sf_dir).select(F.col("c_custkey").alias("id")).withColumn("keys", keys)
    marks = F.expr("transform(if(id % 2 = 0, keys, reverse(keys)), (k, i) -> if(i % 2 = 0, concat('dice [cite:', k, ']algo ', i, '[/cite]'), concat('y [cite:', k, ']')))")
    text = F.concat(F.lit("Como [cite:none], "), F.array_join(marks, ", "), F.lit(" y otra vez [cite:"), F.col("keys")[0], F.lit("]."))
    known = customers.select("id", F.explode(F.concat("keys", F.array(F.lit("art_y")))).alias("key"))
    return cites.cited_keys(customers.select("id", text.alias("text")), known, "id", "text").select("id", "key", F.col("place").cast("long").alias("place"))


@query("""WITH u AS (SELECT c_custkey AS c, unnest(range(1, 2 + c_custkey % 3)) AS j, 1 + c_custkey % 3 AS n FROM customer),
  x AS (SELECT *, CASE WHEN c % 5 = 0 THEN 1 ELSE j END AS number, CASE WHEN c % 5 = 0 THEN n ELSE j END AS k FROM u)
  SELECT c::VARCHAR AS exam_id, j AS place, number, '¿Cuál es el caso ' || j || CASE WHEN (c + j) % 2 = 0 THEN ' de la serie ' || c ELSE '' END || '?' AS question, 'Valor ' || (c + j) AS a, 'Valor ' || (c * j) || CASE WHEN (c + j) % 3 = 0 THEN ' que sigue' ELSE '' END AS b,
    CASE WHEN (c + j) % 2 = 1 THEN 'Valor ' || c END AS c, substr('abc', (1 + (c + k) % 3)::INT, 1) AS answer FROM x""")
def exam_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, options and key of a printed exam as text, one for every customer; in some all questions have one number."""
    number = "if(c % 5 = 0, 1, j)"
    ask = f"concat({number}, if(j % 2 = 0, '. - ', '.- '), '¿Cuál es el caso ', j, if((c + j) % 2 = 0, concat('\\nde la serie ', c), ''), '?\\n')"
    options = "concat('a) Valor ', c + j, '\\nPágina ', j, ' de 9\\n', 'b) Valor ', c * j, if((c + j) % 3 = 0, '\\nque sigue', ''), '\\n', if((c + j) % 2 = 1, concat('C) Valor ', c, '\\n'), ''))"
    key = f"concat({number}, if(j % 2 = 0, '. ', ' '), upper(substr('abc', 1 + (c + j) % 3, 1)), '\\n')"
    each = "array_join(transform(sequence(1, 1 + c % 3), j -> {}), '')"
    content = F.expr(f"concat('PRIMER EJERCICIO – 3 DE MAYO DE 2024\\n\\n', {each.format(f'concat({ask}, {options})')}, 'FISCALÍA GENERAL DEL ESTADO\\n', {each.format(key)})")
    exam = _customers(spark, sf_dir).select(F.col("c_custkey").alias("c")).select(F.col("c").cast("string").alias("exam_id"), content.alias("content"))
    rows = exams.questions(exam).join(exams.answer_key(exam), ["exam_id", "number"], "left")
    return rows.select("exam_id", F.col("place").cast("long").alias("place"), F.col("number").cast("long").alias("number"), "question", *[F.col("options")[x].alias(x) for x in "abc"], "answer")


@query("""WITH RECURSIVE o AS (SELECT doc_id // 500 AS block, doc_id, coalesce(least(length(text), 72000) // 4, 0)::INT AS n, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS i FROM documents),
  r AS (SELECT block, doc_id, n, i, 0 AS bin_no, 1 AS k, n AS t FROM o WHERE i = 1
    UNION ALL SELECT o.block, o.doc_id, o.n, o.i, r.bin_no + (r.k >= 100 OR r.t + o.n > 18000)::INT, CASE WHEN r.k >= 100 OR r.t + o.n > 18000 THEN 1 ELSE r.k + 1 END, CASE WHEN r.k >= 100 OR r.t + o.n > 18000 THEN o.n ELSE r.t + o.n END
    FROM r JOIN o ON o.block = r.block AND o.i = r.i + 1)
  SELECT block, doc_id, bin_no, n AS n_tokens FROM r""")
def bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in calls of bounded size, in blocks of 500."""
    docs = table(spark, sf_dir, "documents").withColumn("block", F.expr("doc_id div 500"))
    return batches.bins(docs, "doc_id", "text", "block")


@query("SELECT doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 500 AS INT) AS chunk_no FROM documents")
def chunk_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 500 documents of every source."""
    return batches.numbered_chunks(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id").select("doc_id", "chunk_no")
