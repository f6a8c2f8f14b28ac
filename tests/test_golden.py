"""Golden rows: one law, sentences, titles, answers and an exam, with what must come of them."""

from pyspark.sql import functions as F

from lexlake.functions import citations as cites
from lexlake.functions import numbers
from lexlake.functions import text as fn
from lexlake.operators import exams, law_tree, linking
from lexlake.sources import laws

LAW = """<response><data><metadatos><identificador>{id}</identificador><titulo>Ley de prueba</titulo></metadatos><texto>
<bloque id="tu" tipo="encabezado" titulo="TÍTULO I"><version id_norma="{id}" fecha_publicacion="20100101" fecha_vigencia="20100102"><p>TÍTULO I</p></version></bloque>
<bloque id="cu" tipo="encabezado" titulo="CAPÍTULO II"><version id_norma="{id}" fecha_publicacion="20100101" fecha_vigencia="20100102"><p>CAPÍTULO II</p></version></bloque>
<bloque id="a1" tipo="precepto" titulo="Artículo 1"><version id_norma="{id}" fecha_publicacion="20100101" fecha_vigencia="20100102"><p>Artículo 1. Objeto.</p><p>1. Según el artículo 14 de la Constitución Española y el artículo siguiente.</p></version>
<version id_norma="BOE-2" fecha_publicacion="20150101" fecha_vigencia="20150201"><p>Artículo 1. Objeto.</p><p>1. Conforme al art. 2.</p><p>a) Se <em>modifica</em> todo.</p></version></bloque>
<bloque id="a2" tipo="precepto" titulo="Artículo 2"><version id_norma="{id}" fecha_publicacion="20100101" fecha_vigencia="20100102"><p>Artículo 2 bis. Tabla.</p><table><tr><td><p>Concepto</p></td><td><p>Euros</p></td></tr><tr><td>Item</td><td></td></tr></table></version></bloque>
<bloque id="c" tipo="precepto" titulo="Artículos 1 y 2"><version id_norma="BOE-3" fecha_publicacion="20200101" fecha_vigencia="20200202"><p>Artículos 1 y 2</p><p>(Derogados)</p></version></bloque>
<bloque id="fi" tipo="firma" titulo=""><version id_norma="{id}" fecha_publicacion="20100101" fecha_vigencia="20100102"><p>Firmado</p></version></bloque>
</texto></data></response>"""

VERSIONS = [
    ("L1_a1_0", "Artículo 1. Objeto.", "1", "Título I, Capítulo Ii", "2010-01-02", "2015-02-01"),
    ("L1_a1_1", "Artículo 1. Objeto.", "1", "Título I, Capítulo Ii", "2015-02-01", "2020-02-02"),
    ("L1_a1_2", "Artículo 1", "1", "Título I, Capítulo Ii", "2020-02-02", None),
    ("L1_a2_0", "Artículo 2 bis. Tabla.", "2 bis", "Título I, Capítulo Ii", "2010-01-02", "2020-02-02"),
    ("L1_a2_1", "Artículo 2", "2", "Título I, Capítulo Ii", "2020-02-02", None),
]

TABLE = "| Concepto | Euros |\n|---|---|\n| Item | - |"
FIRST = "1. Según el artículo 14 de la Constitución Española y el artículo siguiente."
TEXTS = [("L1_a1_0", FIRST), ("L1_a1_1", "1. Conforme al art. 2.\n\na) Se modifica todo."), ("L1_a1_2", "(Derogados)"), ("L1_a2_0", TABLE), ("L1_a2_1", "(Derogados)")]

RICH = [(a, t.replace("\n\na)", "\n  a)")) for a, t in TEXTS]

CHANGES = [
    ("L1_a1_0", "L1_a1_1", "apartado_numerico", "1.", "modified"),
    ("L1_a1_0", "L1_a1_1", "apartado_alfa", "1. a)", "added"),
    ("L1_a1_1", "L1_a1_2", "apartado_numerico", "1.", "removed"),
    ("L1_a1_1", "L1_a1_2", "apartado_alfa", "1. a)", "removed"),
    ("L1_a1_1", "L1_a1_2", "parrafo", "1", "added"),
    ("L1_a2_0", "L1_a2_1", "table", "1", "removed"),
    ("L1_a2_0", "L1_a2_1", "parrafo", "1", "added"),
]

EDGES = [("L1_a1_1", "NEXT_VERSION", "L1_a1_2"), ("L1_a1_0", "NEXT_VERSION", "L1_a1_1"), ("L1_a2_0", "NEXT_VERSION", "L1_a2_1"), ("L1_a1_0", "PART_OF", "L1"), ("L1_a1_1", "PART_OF", "L1"), ("L1_a1_2", "PART_OF", "L1"), ("L1_a2_0", "PART_OF", "L1"), ("L1_a2_1", "PART_OF", "L1")]

SENTENCES = [
    "Según el artículo 14 de la Constitución Española, todos son iguales.",
    "El artículo 1902 del Código Civil regula.",
    "De conformidad con el art. 24 CE y art. 1 CC.",
    "La Ley Orgánica 10/1995, de 23 de noviembre, aprueba.",
    "Como en el artículo anterior, y salvo lo del artículo 5 de esta ley.",
    "Los artículos 5 a 12 de esta Ley son básicos.",
    "Según la STC 1234/2020, de 3 de marzo, y la STS 567/2019.",
    "según el artículo 3 de la Ley 29/2012",
    "Conforme a la LOPJ y al ET.",
    "La Directiva 2006/123/CE y el Reglamento (UE) 2016/679 obligan.",
    "Según la citada Ley Orgánica 6/1985.",
    "Según la Ley 999/2099 y la Ley 39/2015.",
    "el artículo 1.428 de la LEC",
]
REFS = [
    (0, "constitution", "14", "BOE-A-1978-31229"),
    (1, "code", "1902", "BOE-A-1889-4763"),
    (2, "abbreviated", "24", "BOE-A-1978-31229"),
    (2, "abbreviated", "1", "BOE-A-1889-4763"),
    (3, "organic_law", None, None),
    (4, "internal", "6", "S"),
    (4, "internal", "5", "S"),
    (5, "internal", None, "S"),
    (6, "judicial", None, None),
    (6, "judicial", None, None),
    (7, "law", "3", None),
    (8, "abbreviated", None, "BOE-A-1985-12666"),
    (8, "abbreviated", None, "BOE-A-2015-11430"),
    (9, "eu_legislation", None, None),
    (9, "eu_legislation", None, None),
    (10, "organic_law", None, "BOE-A-1985-12666"),
    (11, "law", None, None),
    (11, "law", None, "BOE-A-2015-10565"),
    (12, "abbreviated", "1428", "BOE-A-2000-323"),
]

NUMBER_WORDS = [("cero", "0"), ("veintiún", "21"), ("dieciséis", "16"), ("treinta y uno", "31"), ("treinta_y_uno", "31"), ("cincuenta y uno", "51"), ("noventa y nueve", "99"), ("ciento veintisiete", "127"), ("quinientas", "500"), ("primero", "1"), ("Décima", "10"), ("duodécimo", "12"), ("vigésimo", "20"), ("vigésimo_primero", "21"), ("adicional", None)]
ARTICLES = [("Artículo 14", "14"), ("Art. 1 bis", "1 bis"), ("Artículo 154.1", "154"), ("Artículo 1.428", "1428"), ("art. 24", "24"), ("Artículo cincuenta y uno", "51"), ("Artículo primero", "1"), ("Disposición adicional primera", None), ("", None)]
CITES = [("Artículo 14", "Constitución Española", "BOE-1978-000014", "art_14_ce_000014"), ("Artículo 3.b", "Código Civil", "x7", "art_3_b_cc_x7"), ("", "Ley de la Jurisdicción", None, "ref_lj"), ("Artículo 2", "Real Decreto Legislativo del Estatuto de los Trabajadores", "", "art_2_rdle")]
FOLDS = [("Constitución Española", "constitucion espanola"), ("a.b.Año/Ñu  3", "ano nu 3"), ("ÁÉÍÓÚ", "aeiou")]
ANSWERS = [("b", "b"), ("a) porque", "a"), ("(c) es", "c"), ("Respuesta: d", "d"), ("La opción: b", "b"), ("es la c", "c"), ("no sé", None), ("", None), ("xyz b2", "b")]
EXAM = "EXAMEN\n1.- ¿Cuál es\nla capital?\na) Madrid\nb) Barcelona\nPágina 1 de 2\n2. - ¿Y el río?\na) Ebro que\nes largo\nb) Tajo\n1 A\n2. B\n"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def law(spark, text=None, law_id="L1"):
    source = spark.createDataFrame([(law_id, text or LAW.format(id=law_id))], "law_id string, xml string")
    return law_tree.distributed(laws.law_lines(source))


def test_one_law(spark):
    lines = law(spark)
    versions, parts = law_tree.article_versions(lines).cache(), law_tree.elements(lines)
    day = lambda c: F.to_date(c).cast("string").alias(c)
    assert rows(versions, "article_id", "name", "clean_number", "path", day("valid_from"), day("valid_to")) == sorted(VERSIONS, key=repr)
    assert rows(versions, "article_id", "full_text") == sorted(TEXTS)
    assert rows(law_tree.indented_text(parts), "article_id", "rich_text") == sorted(RICH)
    assert rows(law_tree.element_changes(parts, versions), "old_id", "new_id", "node_type", "name", "change") == sorted(CHANGES)
    assert rows(law_tree.graph_rows(versions)[1].filter("rel <> 'PREVIOUS_VERSION'"), "src", "rel", "dst") == sorted(EDGES)
    own = versions.select("article_id", "law_id", "clean_number", "full_text", "valid_from", "valid_to")
    other = spark.createDataFrame([("BOE-A-1978-31229_14", "BOE-A-1978-31229", "14", "")], "article_id string, law_id string, clean_number string, full_text string")
    both = own.unionByName(other.withColumns({"valid_from": F.lit("1978-12-29").cast("timestamp_ntz"), "valid_to": F.lit(None).cast("timestamp_ntz")}))
    assert rows(linking.linked(linking.extracted(own), both), "src", "rel", "dst") == [("L1_a1_0", "REFERS_TO", "BOE-A-1978-31229_14"), ("L1_a1_0", "REFERS_TO", "L1"), ("L1_a1_1", "REFERS_TO", "L1")]


def test_law_is_parsed_once(spark):
    calls = spark.sparkContext.accumulator(0)
    source = spark.createDataFrame([("L1", LAW.format(id="L1"))], "law_id string, xml string")
    lines = laws.law_lines(source).withColumn("kind", F.udf(lambda x: (calls.add(1), x)[1])("kind"))
    spread = law_tree.distributed(lines)
    n = calls.value
    assert n > 0
    law_tree.article_versions(spread).collect()
    law_tree.elements(spread).collect()
    assert calls.value == n


def test_titles_of_blocks(spark):
    titles = {"Artículos 3 a 5": [3, 4, 5], "Arts. 7, 8 y 9.": [7, 8, 9], "Artículos 1 y 2": [1, 2], "Artículo 4": [4], "art. 12 bis": [12], "Artículo 3.º": [3], "Artículos 5 a 3": None, "Artículo 1 de la ley 2": None, "Artículos 1, 2": None, "Disposición 3": None, "": None, "TÍTULO I": None}
    df = spark.createDataFrame([(t,) for t in [*titles, None]], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", law_tree.title_numbers(F.col("t")).alias("n")).collect()} == titles | {None: None}


def test_sentences(spark):
    source = spark.createDataFrame([("S", "7", t, str(i), None) for i, t in enumerate(SENTENCES)], "law_id string, clean_number string, full_text string, article_id string, valid_from timestamp_ntz")
    got = rows(linking.extracted(source), F.col("article_id").cast("int"), "reference_type", "target_number", "target_law")
    assert got == sorted(REFS, key=repr)


def test_statutes(spark):
    of = lambda t: [(r["kind"], r["article"], r["law_type"]) for r in cites.find_citations(t)]
    assert of("artículo 5 del Estatuto de Autonomía de Cataluña, y más") == [("article_of_law", "5", "estatuto de autonomía de cataluña")]
    assert of("el Estatuto del País Vasco y el Estatuto de Galicia") == [("named_law", None, "estatuto del país vasco"), ("named_law", None, "estatuto de galicia")]
    assert of("Estatuto de Autonomía de la Comunidad Valenciana") == [("named_law", None, "estatuto de autonomía de la comunidad valenciana")]
    assert of("el Estatuto de los Trabajadores, el estatuto de autonomía vigente, un estatuto de personal") == [("named_law", None, "estatuto de los trabajadores"), ("named_law", None, "estatuto de autonomía")]


def test_words_titles_keys_and_answers(spark):
    df = spark.createDataFrame([(w,) for w, _ in NUMBER_WORDS], "w string")
    assert {r["w"]: r["n"] for r in numbers.with_number(df, "w", "n").collect()} == {w: None if n is None else int(n) for w, n in NUMBER_WORDS}
    more = [("Artículo 154.1 bis", "154 bis"), ("artículos 1.428.000 y", "1428000"), ("14", "14"), ("Artículo 12.º. Objeto", "12"), ("Art.7", "7"), ("Artículo 2 bis. Tabla.", "2 bis"), (None, None), ("Anexo 3", None)]
    df = spark.createDataFrame([(w,) for w, _ in ARTICLES + more], "t string")
    assert {r["t"]: r["n"] for r in numbers.with_article_number(df, "t", "n").collect()} == dict(ARTICLES + more)
    df = spark.createDataFrame(CITES, "number string, title string, id string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", fn.cite_key(F.col("number"), F.col("title"), F.col("id"))).collect())
    df = spark.createDataFrame(FOLDS, "name string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", fn.normalized(F.col("name"))).collect())
    more = [("La c es", "c"), ("la\tb", "b"), ("labor", "a"), ("respuesta:  :a b", "b"), ("Opción d.", "d"), (" A ", "a"), ("ninguna", "a"), ("(e) no", None), ("aé", "a"), ("es ñd", "d"), ("x d \n", "d"), ("(b", "b"), ("la abeja", "a"), ("respuesta x, respuesta: b, a", "b")]
    df = spark.createDataFrame(ANSWERS + more + [(None, None)], "answer string, want string")
    got = {r["answer"]: r["got"] for r in df.withColumn("got", fn.answer_letter(F.col("answer"))).collect()}
    assert got == dict(ANSWERS + more) | {None: None}


def test_exam(spark):
    exam = spark.createDataFrame([("e", EXAM), ("empty", ""), ("none", None), ("twice", "1.- x y\na) b\n1.- z?\na) c\n12 de 30\nPRIMER EJERCICIO – 3 DE MAYO DE 2024\nb) d\nb) e\n1 b\n1. A")], "exam_id string, content string")
    got = rows(exams.questions(exam).join(exams.answer_key(exam), ["exam_id", "number"], "left"), "exam_id", "place", "number", "question", F.map_entries("options").alias("o"), "answer")
    flat = [(a, b, c, d, [tuple(x) for x in o], e) for a, b, c, d, o, e in got]
    assert flat == [("e", 1, 1, "¿Cuál es la capital?", [("a", "Madrid"), ("b", "Barcelona")], "a"), ("e", 2, 2, "¿Y el río?", [("a", "Ebro que es largo"), ("b", "Tajo")], "b"),
                    ("twice", 1, 1, "x y", [("a", "b")], "a"), ("twice", 2, 1, "z?", [("a", "c"), ("b", "d e")], "a")]


def test_cited_keys(spark):
    answers = spark.createDataFrame([(1, "Como [cite:K]dice[/cite], [cite:none] y [cite:art_x_cc] o [cite:K].")], "id long, text string")
    known = spark.createDataFrame([(1, "K"), (1, "art_x_cc"), (1, "art_y")], "id long, key string")
    assert rows(cites.cited_keys(answers, known, "id", "text"), "key", F.col("place").cast("long")) == [("K", 1), ("art_x_cc", 2)]


def test_saved_graph_leaves_headings_out(spark):
    nodes, edges = law_tree.saved_graph(law(spark))
    labels = {r["id"]: r["label"] for r in nodes.collect()}
    assert not set(labels.values()) & set(law_tree.STRUCTURE)
    assert {r["dst"] for r in edges.collect() if labels[r["src"]] == "articulo"} == {"L1"}
    assert {(r["src"], r["dst"]) for r in edges.collect()} >= {("L1_a1_1#1", "L1_a1_1"), ("L1_a1_1#2", "L1_a1_1#1")}
    ids = [r["seq_id"] for r in nodes.collect()]
    assert len(set(ids)) == len(ids) == nodes.count() and "L1_0" in ids


def test_change_events_are_saved_once(spark):
    lines = law(spark)
    changes = law_tree.element_changes(law_tree.elements(lines), law_tree.article_versions(lines)).cache()
    events = law_tree.change_events(changes).cache()
    assert {(r["target_id"], r["added"], r["modified"], r["removed"]) for r in events.collect()} == {("L1_a1_0", 1, 1, 0), ("L1_a1_1", 1, 0, 2), ("L1_a2_0", 1, 0, 1)}
    assert law_tree.change_events(changes, events).count() == 0
    assert law_tree.change_events(changes, events.limit(1)).count() == 2
