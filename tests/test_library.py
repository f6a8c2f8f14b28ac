"""Operators that no oracle covers: folds, sinks, sources, streams, golden rules."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexlake.functions import numbers, text
from lexlake.functions.citations import find_citations, unique_keys, without_marks
from lexlake.operators import batches, conversations, graph, law_tree, linking, sinks
from lexlake.sources import files, laws
from lexlake.streaming import jobs
from tests.test_golden import LAW

SF = "/root/testdata/sf0.001"


def test_token_budget_is_the_fold(spark):
    rows = spark.createDataFrame([(1, i, 15.0) for i in range(10)] + [(2, 0, 500.0), (2, 1, 60.0), (2, 2, 50.0), (2, 3, 40.0)], "user long, n int, cost double")
    got = conversations.budget(rows, 100, "user", ["n"], "cost").orderBy("user", "n").collect()
    assert [r["accepted"] for r in got] == [True] * 6 + [False] * 4 + [False, True, False, True]
    assert got[-1]["left"] == 0 and all(r["left"] >= 0 for r in got)


def test_bins_are_greedy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("block", F.expr("doc_id div 100"))
    got = {(r["block"], r["doc_id"]): r["bin_no"] for r in batches.bins(docs, "doc_id", "text", "block", 7, 3000).collect()}
    state = {}
    for r in docs.orderBy("doc_id").collect():
        n = min(len(r["text"]), batches.MAX_CHARS) // 4
        b, k, t = state.get(r["block"], (0, 0, 0))
        if k and (k >= 7 or t + n > 3000):
            b, k, t = b + 1, 0, 0
        state[r["block"]] = (b, k + 1, t + n)
        assert got[r["block"], r["doc_id"]] == b
    assert len(got) == docs.count()


def test_metadata_merge_and_citation_keys(spark):
    old = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"x": "y"})], "id int, metadata map<string,string>")
    new = spark.createDataFrame([(1, {"b": "3"}), (3, {"n": "m"})], "id int, metadata map<string,string>")
    got = {r["id"]: r["metadata"] for r in conversations.merged_metadata(old, new, "id").collect()}
    assert got == {1: {"a": "1", "b": "3"}, 2: {"x": "y"}, 3: {"n": "m"}}
    keys = spark.createDataFrame([(1, 0, "k"), (1, 1, "k"), (1, 2, "j"), (2, 0, "k")], "m int, pos int, key string")
    assert [r["key"] for r in unique_keys(keys, "key", "pos", ["m"]).orderBy("m", "pos").collect()] == ["k", "k_1", "j", "k"]
    (r,) = spark.createDataFrame([("a [cite:k]b[/cite] [cite:z]c",)], "t string").select(without_marks(F.col("t")).alias("t")).collect()
    assert r["t"] == "a b c"
    cited = conversations.with_citations(spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, "b"), (1, "a")], "id int, k string"), ["id"], "k")
    assert {r["id"]: r["citations"] for r in cited.collect()} == {1: ["a", "b"], 2: []}


def test_upsert_keeps_rows_whole(spark):
    old = spark.createDataFrame([(1, 7, 7), (2, 5, None)], "id int, a int, b int")
    new = spark.createDataFrame([(1, 1, 9, 1), (1, 2, 1, 0), (3, None, 4, 0)], "id int, a int, b int, at int")
    assert sorted(map(tuple, graph.upsert_nodes(old, new.drop("at")).collect())) == [(1, 2, 1), (2, 5, None), (3, None, 4)]
    assert sorted(map(tuple, graph.upsert_nodes(old, new, order="at").collect())) == [(1, 1, 9), (2, 5, None), (3, None, 4)]


def test_closure_of_cycles_and_many_paths(spark):
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("d", "b"), ("d", "c"), ("c", "a"), ("e", "d"), *[(f"n{k + 1}", f"n{k}") for k in range(14)]], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("n0",)], "id string")
    got = {(r["root"], r["id"]): r["depth"] for r in graph.closure(edges, roots, None).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {"b": 1, "c": 1, "d": 2, "e": 3}
    assert got["n0", "n14"] == 14 and graph.closure(edges, roots).filter("root = 'n0'").count() == 10


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "1", None), ("b", None, "2")], "id string, x string, y string")
    new = spark.createDataFrame([("a", None, "9"), ("c", "3", None)], "id string, x string, y string")
    once = graph.upsert_nodes(old, new)
    assert sorted(map(tuple, once.collect()), key=str) == [("a", "1", "9"), ("b", None, "2"), ("c", "3", None)]
    assert sorted(map(tuple, graph.upsert_nodes(once, new).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_sinks(spark, tmp_path):
    nodes = sinks.dictionary(spark, {"REAL_DECRETO": 7, "LEY": 1}, "rango")
    assert sorted(map(tuple, nodes.collect())) == [("1", "rango", "Ley"), ("7", "rango", "Real Decreto")]
    sinks.write_nodes(nodes, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).filter("label = 'rango'").count() == 2
    more = spark.createDataFrame([("7", "Decreto"), ("9", "Orden")], "id string, name string")
    base = nodes.select("id", "name")
    base.write.parquet(str(tmp_path / "t0"))
    sinks.merge_into(more, str(tmp_path / "t0"), ["id"], str(tmp_path / "t1"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t1")).collect())) == [("1", "Ley"), ("7", "Decreto"), ("9", "Orden")]
    assert [r["id"] for r in sinks.migrate(more, base, ["id"]).collect()] == ["9"]
    assert sinks.evolve(base, {"id": "string", "extra": "int"}).columns == ["id", "name", "extra"]
    sinks.json_lines(base, str(tmp_path / "j"), "id")
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# list\n\nBOE-A-1  remark\nBOE-A-2 # x\n")
    assert [r["id"] for r in files.id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["BOE-A-1", "BOE-A-2"]
    (tmp_path / "acts").mkdir()
    (tmp_path / "acts" / "32016R0679.txt").write_text("TÍTULO: Prueba\n[TITULO] TÍTULO I\n[ARTICULO] Artículo 1: Objeto\nCuerpo uno\nmás\n[ARTICULO] Artículo 2: Fin\nDos\n")
    acts = files.whole_texts(spark, str(tmp_path / "acts"), "txt").select(F.col("name").alias("law_id"), "content")
    got = law_rows(laws.act_articles(laws.marked_lines(acts)))
    assert got == [("32016R0679_articulo_1", "Artículo 1: Objeto", "TÍTULO I", "Cuerpo uno\n\nmás"), ("32016R0679_articulo_2", "Artículo 2: Fin", "TÍTULO I", "Dos")]
    html = "<html><p class='doc-ti'>Reg</p><p class='oj-ti-section-1'>CAPÍTULO I</p><div class='oj-ti-art'>Artículo <i>1</i></div><p class='oj-sti-art'>Objeto</p><p class='oj-normal'>Uno<br>dos</p><p class='other'>no</p></html>"
    frame = spark.createDataFrame([("X", html), ("Y", None)], "law_id string, html string")
    assert law_rows(laws.act_articles(laws.html_lines(frame))) == [("X_articulo_1", "Artículo 1", "CAPÍTULO I", "Objeto\n\nUnodos")]
    assert [r["h"] for r in frame.select(laws.is_html(F.col("html")).alias("h")).collect()] == [True, None]
    for name, inner in (("good", "act.xml"), ("none", "act.txt")):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("META-INF/m.xml", "<m/>")
            z.writestr(inner, "<a/>")
        (tmp_path / f"{name}.zip").write_bytes(data.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.archived_xml(spark, str(tmp_path)).collect()}
    assert rows["good.zip"]["content"] == "<a/>" and rows["none.zip"]["error"] and rows["bad.zip"]["error"]
    listed = spark.createDataFrame([("a", "Ley de aguas", "20200101"), ("b", "Ley de costas", "20210101"), ("c", "Orden", "20220101")], "identificador string, titulo string, fecha_publicacion string")
    assert [r["identificador"] for r in files.search_listing(listed, {"titulo": "LEY"}, start="20190101", limit=1, offset=1).collect()] == ["a"]


def test_formex(spark):
    act = "<ACT><TITLE><TI><P>Reglamento</P></TI></TITLE><ENACTING.TERMS><DIVISION><TITLE><TI><P>CAPÍTULO I</P></TI></TITLE><ARTICLE><TI.ART>Artículo 1</TI.ART><STI.ART><P>Objeto</P></STI.ART><PARAG><NO.PARAG>1.</NO.PARAG><ALINEA>Uno <HT>dos</HT></ALINEA></PARAG><ALINEA>Tres</ALINEA></ARTICLE></DIVISION></ENACTING.TERMS></ACT>"
    frame = spark.createDataFrame([("32016R0001", act), ("bad", "<x")], "law_id string, xml string")
    lines = laws.formex_lines(frame).cache()
    assert [r["law_id"] for r in lines.filter("kind = 'error'").collect()] == ["bad"]
    rows = law_rows(laws.act_articles(lines.filter("kind <> 'error'")))
    assert rows == [("32016R0001_articulo_1", "Artículo 1", "CAPÍTULO I", "Objeto\n\n1. Uno dos\n\nTres")]


def law_rows(df):
    return sorted((r["article_id"], r["title"], r["path"], r["full_text"]) for r in df.collect())


def test_law_reading(spark):
    source = spark.createDataFrame([("L1", LAW.format(id="L1")), ("bad", "<x"), ("none", None)], "law_id string, xml string")
    lines = laws.law_lines(source).cache()
    assert {r["law_id"] for r in lines.filter("kind = 'error'").collect()} == {"bad", "none"}
    assert lines.filter("block_type = 'firma'").count() == 0
    assert {(r["field"], r["value"]) for r in laws.law_metadata(source).collect()} == {("identificador", "L1"), ("titulo", "Ley de prueba")}
    versions = law_tree.article_versions(law_tree.distributed(lines.filter("law_id = 'L1'"))).cache()
    chains = versions.groupBy("law_id", "block_id").agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to"))).alias("v")).collect()
    assert all(a["valid_to"] == b["valid_from"] for c in chains for a, b in zip(c["v"], c["v"][1:], strict=False))
    nodes, edges = law_tree.graph_rows(versions)
    assert graph.missing_ends(edges, nodes, "src").count() == 0 and graph.missing_ends(edges, nodes).count() == 0
    (r,) = law_tree.context_text(versions).filter("article_id = 'L1_a1_1'").collect()
    assert r["context"].startswith("Documento: L1\nContexto: Título I") and "Hasta el 2 de febrero de 2020" in r["context"]
    missing = {(r["key"], r["n"]) for r in linking.unresolved(linking.extracted(spark.createDataFrame([("a", "L", "1", "Ley 999/2099 y STC 1/2020", None)], "article_id string, law_id string, clean_number string, full_text string, valid_from timestamp_ntz"))).collect()}
    assert missing == {("ley 999/2099", 1), ("stc", 1)}


def test_line_kinds_and_elements(spark):
    kinds = {"TÍTULO I": "titulo", "Capítulo II. Algo": "capitulo", "Sección primera": "seccion", "Sección 2.ª Otra": "seccion", "Sección que no": "parrafo", "Subsección única": "subseccion", "Libro III": "libro", "Título": "parrafo", "ANEXO": "anexo", "Anexo IV.": "anexo",
             "Anexo que sigue": "parrafo", "Disposición adicional primera": "disposicion", "Artículo único. X": "articulo_unico", "Art. 5. Y": "articulo", "Artículo primero": "articulo", "Artículo treinta y uno.": "articulo", "Artículo que dice algo": "parrafo",
             "1. Uno": "apartado_numerico", "a) Letra": "apartado_alfa", "1.ª Regla": "ordinal_alfa", "2.º Regla": "ordinal_numerico", "12 de mayo": "parrafo", "": "parrafo"}
    df = spark.createDataFrame([(t,) for t in kinds], "text string").withColumn("kind", F.lit("p"))
    assert {r["text"]: r["node_type"] for r in law_tree.classified(df).collect()} == kinds
    first = ["Artículo 1. X", "Intro", "1. Uno", "a) A", "1.º I", "nota", "b) B", "2. Dos", "a) C"]
    second = ["Artículo 1. X", "Intro nueva", "1. Uno", "b) B", "2. Dos", "a) C", "c) D"]
    rows = [("L", 1, "b", v, k, t, "p") for v, lines in enumerate((first, second)) for k, t in enumerate(lines)]
    parts = law_tree.elements(spark.createDataFrame(rows, "law_id string, block_no int, block_id string, version_no int, line_no int, text string, kind string")).cache()
    got = {r["line_no"]: (r["parent_id"], r["depth"]) for r in parts.filter("article_id = 'L_b_0'").collect()}
    assert got == {1: ("L_b_0", 1), 2: ("L_b_0", 1), 3: ("L_b_0#2", 2), 4: ("L_b_0#3", 3), 5: ("L_b_0#4", 4), 6: ("L_b_0#2", 2), 7: ("L_b_0", 1), 8: ("L_b_0#7", 2)}
    text_ = {r["article_id"]: r["rich_text"] for r in law_tree.indented_text(parts).collect()}["L_b_0"]
    assert text_.split("\n")[:5] == ["Intro", "1. Uno", "  a) A", "    1.º I", "      nota"]
    chain = spark.createDataFrame([("L_b_0", "L_b_1"), ("L_b_1", None)], "article_id string, next_id string")
    changes = {(r["name"], r["change"]) for r in law_tree.element_changes(parts, chain).collect()}
    assert changes == {("1", "modified"), ("1. a)", "removed"), ("a) 1.º", "removed"), ("1.º 1", "removed"), ("2. c)", "added")}


def test_citation_overlaps():
    kinds = [(r["kind"], r["article"]) for r in find_citations("art. 5 bis de la Ley 1/2000, art. 96.2 y Reglamento (CE) n.º 1221/2009; artículos 101 y 102 del TFUE")]
    assert kinds == [("article_of_law", "5 bis"), ("internal", "96"), ("eu_legislation", None), ("eu_treaty", "101"), ("eu_treaty", "102")]
    assert find_citations(None) == [] and find_citations("") == []
    of = lambda t: [(r["kind"], r["article"], r["abbreviation"] or r["law_number"] or r["law_type"]) for r in find_citations(t)]
    assert of("El art. 10 bis de la Ley y el artículo 149.1.23.ª CE.") == [("internal", "10 bis", None), ("abbreviated", "149", "CE")]
    assert of("los artículos 96, 782 y 808 de la citada Ley Orgánica 6/1985") == [("article_of_law", n, "6/1985") for n in ("96", "782", "808")]
    assert of("Real Decreto-ley 8/2010, Real Decreto Legislativo 1/2013 y Estatuto de Autonomía") == [("law", None, "8/2010"), ("law", None, "1/2013"), ("named_law", None, "estatuto de autonomía")]
    assert of("el (CE) no, ni CECE, ni UNO_CE; SÍ CE") == [("abbreviated", None, "CE")]
    r = find_citations("artículos 5 a 12")[0]
    assert (r["article"], r["range_end"]) == ("5", "12")


def test_number_spellings():
    assert all(len(set(numbers.cardinal(n))) for n in range(1000))
    assert "doscientas treinta y una" in numbers.cardinal(231) and numbers.cardinal(16) == ["dieciseis"]
    assert "vigesima primera" in numbers.ordinal(21) and "tercer" in numbers.ordinal(3)


@pytest.mark.parametrize(("message", "previous", "reason"), [("¿Y el artículo 15?", True, "contains_legal_terms"), ("¿Estás seguro?", True, "matches_clarification_pattern"), ("¿Estás seguro?", False, "no_previous_context"), ("vale", True, "matches_clarification_pattern"), ("hola", True, "default"), ("leyenda del lago", True, "default"), ("su ley", True, "contains_legal_terms"), ("art.5", True, "contains_legal_terms"), ("art. 5", True, "default"), ("apelaciónes", True, "default"), ("una pregunta larga que pasa de seis palabras", True, "query_too_long")])
def test_decisions(spark, message, previous, reason):
    df = spark.createDataFrame([(message, previous)], "m string, p boolean")
    (r,) = df.select(text.context_decision(F.col("m"), F.col("p"))["reason"].alias("r")).collect()
    assert r["r"] == reason


def test_text_helpers(spark):
    df = spark.createDataFrame([('```json\n["a", "b", "c"]\n```', "20240305", [("articulo", "1"), ("ROOT", "x"), ("titulo", "PRIMERO")])], "j string, d string, p array<struct<type:string,name:string>>")
    (r,) = df.select(text.question_list(F.col("j"), 2).alias("q"), text.parsed_date(F.col("d")).cast("string").alias("d"), text.context_path(F.col("p")).alias("p"), text.constant_name(F.lit("Real Decreto-ley")).alias("c")).collect()
    assert r["q"] == ["a", "b"] and r["d"] == "2024-03-05" and r["p"] == "Titulo Primero > Articulo 1" and r["c"] == "REAL_DECRETO_LEY"


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode="complete"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    days = {(str(r["day"]), r["event_type"]): r["n"] for r in run(jobs.daily_counters(stream), "days").collect()}
    want = {(str(r["d"]), r["event_type"]): r["count"] for r in events.groupBy(F.to_date("ts").alias("d"), "event_type").count().collect()}
    assert days == want
    assert run(jobs.sessions(stream), "sess").agg(F.sum("n_events")).first()[0] == events.count()
    assert run(jobs.usage(stream), "usage").count() > 0
    spent = run(jobs.token_budget(stream, 100.0), "budget", "append")
    assert spent.count() == events.count() and spent.filter("left < 0").count() == 0
    jobs.merge_daily(jobs.daily_counters(stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_contexts(spark):
    from lexlake.operators import context as ops

    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, position int")
    new = spark.createDataFrame([("b", 1), ("c", 2), ("d", 3)], "id string, position int")
    gone = spark.createDataFrame([("a",), ("d",)], "id string")
    assert [(r["id"], r["position"]) for r in ops.accumulated(old, new, gone).orderBy("position").collect()] == [("b", 1), ("c", 2)]
    texts = spark.createDataFrame([("x",), ("y",), ("y",)], "text string")
    cache = texts.filter("text = 'x'").select(F.sha2("text", 256).alias("key"), ops.stub_embedding(F.col("text")).alias("embedding"))
    hits, more = ops.cached_embeddings(texts, cache)
    assert hits.count() == 1 and more.count() == 1
    assert abs(sum(v * v for v in more.first()["embedding"]) - 1) < 1e-9
    decisions = spark.createDataFrame([(1, True), (2, False)], "k int, needs_search boolean")
    both = [spark.createDataFrame([(1, w), (2, w)], "k int, context string") for w in ("new", "old")]
    assert {r["k"]: r["context"] for r in ops.reused(decisions, *both, "k").collect()} == {1: "new", 2: "old"}


def test_parts_of_acts_and_journals(spark):
    kinds = {"32016R0679": "REG", "32019L0771": "DIR", "32000D0001": "DEC", "32000H0001": "REC", "12016": "OTHER", "12016P/TXT": "OTHER"}
    rows = spark.createDataFrame([(c,) for c in kinds], "celex string")
    assert {r["celex"]: r["kind"] for r in rows.select("celex", text.celex_type(F.col("celex")).alias("kind")).collect()} == kinds
    parts = {"OJ L 123, 01/01/2024, p. 1": ("L", "123", "01/01/2024"), "OJ C 7": ("C", "7", None), "DO L 1": (None, None, None)}
    rows = spark.createDataFrame([(c,) for c in parts], "ref string").withColumn("r", text.journal_reference(F.col("ref")))
    assert {r[0]: tuple(r[1:]) for r in rows.select("ref", "r.series", "r.number", "r.date").collect()} == parts


def test_vectors_as_bytes(spark):
    from lexlake.functions.vectors import packed, unpacked

    rows = spark.createDataFrame([(1, [1.5, -2.0]), (2, []), (3, None)], "k int, v array<float>").withColumn("b", packed(F.col("v")))
    got = {r["k"]: (r["b"] and bytes(r["b"]), r["u"]) for r in rows.select("k", "b", unpacked(F.col("b")).alias("u")).collect()}
    assert got == {1: (b"\x00\x00\xc0?\x00\x00\x00\xc0", [1.5, -2.0]), 2: (b"", []), 3: (None, None)}


def test_citations_are_sought_where_one_may_begin(monkeypatch):
    from lexlake.functions.citations import Scan

    asked, real = [], Scan.law
    monkeypatch.setattr(Scan, "law", lambda self, i, alone: (asked.append(self.raw[i]), real(self, i, alone))[1])
    text = "1. Regla " + "número 5, " * 50 + "conforme al artículo 3 de esta ley y al art. 14 CE. {}Ley Orgánica 6/1985 y STC 3/2020"
    # letters that lower case lengthens, or that depend on those around them
    for odd in ("", "İ ", "ΑΣ "):
        asked.clear()
        found = [(text.format(odd)[r["start"] : r["end"]], r["article"], r["law_number"]) for r in find_citations(text.format(odd))]
        assert found == [("artículo 3", "3", None), ("art. 14 CE", "14", None), ("Ley Orgánica 6/1985", None, "6/1985"), ("STC 3/2020", None, "3/2020")]
        assert len(asked) < 10


def test_titles_are_cut_into_words_once(spark):
    from lexlake.functions.text import article_number

    df = spark.createDataFrame([(t,) for t in ("Artículo 1.428 bis, dos", "Art. 3.1", "5 ter", "7, 8", "Artículo", "", None)], "t string")
    got = df.select(article_number(F.col("t")).alias("n"), law_tree.title_numbers(F.col("t")).alias("k"))
    assert [tuple(r) for r in got.collect()] == [("1428 bis", None), ("3", None), ("5 ter", None), ("7", None), (None, None), (None, None), (None, None)]
    for c in ("n", "k"):
        assert got.select(c)._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
