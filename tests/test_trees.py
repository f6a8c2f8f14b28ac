"""Interval labels, contraction and intervals in force, against plain Python; hot keys and slices."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexlake import session
from lexlake.operators import analytics, graph, law_tree, trees, versions
from lexlake.sources import laws


def forest(rng, n):
    parent = {}
    for i in range(1, n):
        if rng.random() < 0.95:
            parent[i] = rng.randrange(max(0, i - 1 - rng.randrange(40)), i)
    return parent


def ancestors(parent, i):
    out = []
    while i in parent:
        i = parent[i]
        out.append(i)
    return out


def test_labels_against_plain_python(spark):
    rng = random.Random(5)
    parent = forest(rng, 600)
    edges = spark.createDataFrame(list(parent.items()) + [(900, 901), (901, 900), (902, 901), (None, 3)], "src long, dst long").repartition(7)
    labels = trees.labelled(edges).cache()
    got = {r["id"]: r for r in labels.collect()}
    nodes = set(parent) | set(parent.values())
    assert set(got) == nodes
    for i in nodes:
        up = ancestors(parent, i)
        assert (got[i]["ancestors"], got[i]["depth"], got[i]["root"]) == (up[::-1], len(up), up[-1] if up else i)
        below = {x for x in nodes if i in ancestors(parent, x)}
        assert {x for x in nodes if got[i]["pre"] < got[x]["pre"] <= got[i]["last"]} == below
    roots = [(i,) for i in rng.sample(sorted(nodes), 30)]
    want = sorted((r, x, ancestors(parent, x).index(r) + 1) for (r,) in roots for x in nodes if r in ancestors(parent, x))
    few = trees.descendants(labels, spark.createDataFrame(roots, "id long"))
    assert sorted(map(tuple, few.collect())) == want
    many = trees.descendants(labels, spark.createDataFrame(roots * 60, "id long"))
    assert sorted(map(tuple, many.collect())) == want
    closure = graph.closure(edges.filter("src < 900"), spark.createDataFrame(roots, "id long"), None)
    assert sorted((r["root"], r["id"], r["depth"]) for r in closure.collect()) == want
    seqs = trees.numbered(labels, F.col("root").cast("string")).collect()
    for root in {r["root"] for r in seqs}:
        own = sorted((r["seq"], r["pre"]) for r in seqs if r["root"] == root)
        assert [a for a, _ in own] == list(range(1, len(own) + 1)) and own == sorted(own, key=lambda x: x[1])


def test_texts_in_order(spark):
    edges = spark.createDataFrame([("b", "r", 2), ("a", "r", 3), ("c", "b", 1), ("d", "b", 0)], "src string, dst string, place int")
    texts = spark.createDataFrame([("r", ""), ("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")], "id string, text string")
    labels = trees.labelled(edges, F.col("place"))
    (r,) = trees.in_order(labels, texts, sep="\n", step="-").collect()
    assert tuple(r) == ("r", "B\n-D\n-C\nA")


def test_contraction_against_plain_python(spark):
    rng = random.Random(6)
    parent = forest(rng, 400)
    gone = set(rng.sample(range(400), 200))
    edges = spark.createDataFrame(list(parent.items()), "src long, dst long")
    got = sorted(map(tuple, trees.contracted(edges, spark.createDataFrame([(i,) for i in gone], "id long")).collect()))
    want = sorted((i, next(a for a in ancestors(parent, i) if a not in gone)) for i in parent if i not in gone and any(a not in gone for a in ancestors(parent, i)))
    assert got == want and len(want) > 100
    assert trees.contracted(edges, spark.createDataFrame([], "id long")).count() == len(parent)


def brute_valid(asks, rows):
    out = {}
    for key, i, at in asks:
        found = [(f is None, f or dt.datetime.min, v) for k, v, f, t in rows if k == key and (at is None or f is not None and f <= at and (t is None or at < t))]
        if found:
            out[i] = max(found)[2]
    return out


@pytest.mark.parametrize("spread", [3, 500, 40_000])
def test_intervals_in_force(spark, spread):
    rng = random.Random(spread)
    day = lambda n: dt.datetime(2000, 1, 1) + dt.timedelta(hours=n)
    rows = []
    for v in range(700):
        a = rng.randrange(spread)
        rows.append((rng.choice([0, 0, 0, 1, 2]), v, None if rng.random() < 0.03 else day(a), None if rng.random() < 0.2 else day(a + rng.choice([0, 1, 5, spread // 2, spread]))))
    asks = [(rng.choice([0, 0, 1, 2, 3]), i, None if rng.random() < 0.05 else day(rng.randrange(-10, 2 * spread + 10))) for i in range(900)]
    left = spark.createDataFrame(asks, "k long, i long, at timestamp_ntz")
    right = spark.createDataFrame(rows, "k long, v long, valid_from timestamp_ntz, valid_to timestamp_ntz")
    got = versions.valid_at(left, right, ["k"], "i", "at", "v").collect()
    assert {r["i"]: r["target_id"] for r in got} == brute_valid(asks, rows)


def test_a_key_of_many_versions(spark):
    n = 100_000
    start = F.expr("timestamp_ntz'1900-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int))")
    chain = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("v"), start.alias("valid_from"), F.when(F.col("id") < n - 1, start + F.expr("INTERVAL 1 HOUR")).alias("valid_to"))
    asks = spark.range(30_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.expr("timestamp_ntz'1900-01-01 00:30:00' + make_interval(0, 0, 0, 0, cast(id * 5 as int))").alias("at"))
    got = versions.valid_at(asks, chain, ["k"], "i", "at", "v")
    assert got.filter(F.col("target_id") != F.least(F.col("i") * 5, F.lit(n - 1))).count() == 0 and got.count() == 30_000


def test_sessions_and_usage_by_slices(spark):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 2, None]), i, None if rng.random() < 0.02 else start + dt.timedelta(seconds=60 * rng.randrange(9000)), float(rng.randrange(9))) for i in range(1500)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, value double")
    cells = lambda df, *c: sorted((tuple(r) for r in df.select(*c).collect()), key=repr)
    whole = cells(analytics.sessions(events), "event_id", "session_no")
    for minutes in (7, 60, 1440, 10**6):
        assert cells(analytics.sliced_sessions(events, slice_minutes=minutes), "event_id", "session_no") == whole
    timed = events.filter("ts IS NOT NULL")
    whole = cells(analytics.sliding_usage(timed, 600), "event_id", "usage")
    for seconds in (600, 3600, 10**7):
        assert cells(analytics.sliding_usage(timed, 600, slice_seconds=seconds), "event_id", "usage") == whole
    with pytest.raises(ValueError):
        analytics.sliding_usage(timed, 600, slice_seconds=599)


def test_usage_counts_by_the_microsecond(spark):
    start = dt.datetime(2024, 1, 1, 12)
    at = [(1, 0.2), (2, 0.9), (3, 600.1), (4, 600.2), (5, 600.200001)]
    rows = [(1, i, start + dt.timedelta(seconds=s), float(10**i)) for i, s in at]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, value double")
    want = {1: 10, 2: 110, 3: 1110, 4: 11110, 5: 111100}
    for seconds in (None, 600, 3600):
        assert {r["event_id"]: r["usage"] for r in analytics.sliding_usage(events, 600, slice_seconds=seconds).collect()} == want


def odd_lines(spark, seed, n_laws=12):
    """Lines of laws with headings in any order, also inside articles, lines before an article's own, and articles of several versions."""
    rng = random.Random(seed)
    words = ["LIBRO I", "TÍTULO I", "CAPÍTULO I", "Sección primera", "Subsección primera"]
    inside = ["1. Uno", "a) A", "1.º I", "nota", "2. Dos", "b) B", "2.ª J", "otra", "TÍTULO II", "Sección segunda"]
    rows = []
    for law in range(n_laws):
        for block in range(rng.randrange(1, 9)):
            if rng.random() < 0.4:
                rows.append((f"L{law}", block, f"h{block}", 0, 0, rng.choice(words)))
                continue
            for version in range(rng.randrange(1, 4)):
                # a heading's id doesn't tell versions apart
                texts = rng.choices(inside if version == 0 else inside[:-2], k=rng.randrange(9))
                texts.insert(min(len(texts), rng.choice([0, 0, 0, 1])), f"Artículo {block}. X")
                rows += [(f"L{law}", block, f"a{block}", version, k, t) for k, t in enumerate(texts)]
    schema = "law_id string, block_no int, block_id string, version_no int, line_no int, text string"
    return spark.createDataFrame(rows, schema).withColumns({"kind": F.lit("p"), "block_title": F.lit(""), "block_type": F.lit("precepto")})


def test_saved_graph_is_the_tree_of_the_lines(spark, monkeypatch):
    lines = odd_lines(spark, 3).cache()
    nodes, edges = law_tree.tree_edges(lines)
    labels = trees.numbered(trees.labelled(edges, F.col("place")), F.col("root"), first=0)
    skipped = nodes.filter(F.col("node_type").isin(law_tree.STRUCTURE)).select("id")
    want = nodes.join(skipped, "id", "left_anti").join(labels.select("id", "seq_id"), "id", "left").select("id", "node_type", "name", "seq_id")
    cells = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    want, linked = cells(want), cells(trees.contracted(edges, skipped))
    # no table is kept between its steps
    monkeypatch.setattr(type(lines), "checkpoint", None)
    got = law_tree.saved_graph(lines)
    assert cells(got[0].select("id", "label", "name", "seq_id")) == want
    assert cells(got[1].select("src", "dst")) == linked and len(linked) > 100


def test_tasks_of_laws_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(law_tree, "LINES", 10)
    lines = odd_lines(spark, 4)
    spread = law_tree.distributed(lines)
    assert spread.rdd.getNumPartitions() == -(-lines.count() // 10) > 16
    plan = law_tree.article_versions(spread.withColumns({"source_id": F.lit("N"), "valid_from": F.lit("20000101")}))._jdf.queryExecution().executedPlan().toString()
    # what follows stays dealt by law: lines once, and the titles' joins
    assert plan.count("Exchange hashpartitioning(law_id") == plan.count("Exchange hashpartitioning")


def test_titles_are_taken_apart_for_blocks_not_lines(spark, monkeypatch):
    plans, kept = {}, law_tree.written
    monkeypatch.setattr(law_tree, "written", lambda df, name, *rows: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and kept(df, name, *rows))
    xml = "<r><bloque id='a1' tipo='precepto' titulo='Artículo 1'><version><p>Artículo 1.</p><p>Uno.</p></version></bloque><bloque id='r' tipo='precepto' titulo='Artículos 1 y 2'><version><p>Artículos 1 y 2</p><p>(Derogado)</p></version></bloque></r>"
    rows = law_tree.distributed(laws.law_lines(spark.createDataFrame([("L", xml)], "law_id string, xml string"))).orderBy("version_no", "line_no").collect()
    assert [(r["block_id"], r["version_no"], r["text"]) for r in rows] == [("a1", 0, "Artículo 1."), ("a1", 0, "Uno."), ("a1", 1, "Artículo 1"), ("a1", 1, "(Derogado)")]
    top, below = plans["law-titles"].split("\n", 1)
    assert "Aggregate" in top and "lambdafunction" in top
    assert "lambdafunction" not in below


def test_written_in_files_of_bounded_rows(spark):
    table = session.written(spark.range(100).coalesce(1), "bounded", 30)
    assert table.count() == 100
    assert sorted(r["n"] for r in table.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()) == [10, 30, 30, 30]


def test_saved_laws_are_told_in_one_pass(spark):
    # a law without blocks that can be read, one block id twice in a law, and a heading inside an article
    odd = [("X9", None, None, None, None, "syntax error"), *[("X8", b, "a", 0, n, t) for b in (1, 2) for n, t in enumerate(["Artículo 1. X", "1. Uno", "TÍTULO I", "a) Dos"])], ("X7", 1, "n", 0, 0, "Nada")]
    lines = odd_lines(spark, 5)
    lines = lines.unionByName(spark.createDataFrame(odd, lines.select("law_id", "block_no", "block_id", "version_no", "line_no", "text").schema).withColumns({"kind": F.lit("p"), "block_title": F.lit(""), "block_type": F.lit("precepto")})).localCheckpoint()
    nodes, edges = law_tree.saved_graph(lines)
    counts = law_tree.saved_counts(lines)
    for df in (nodes, edges, counts):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    nodes, edges = nodes.collect(), edges.collect()
    got = {(r["kind"], r["name"]): r["n"] for r in counts.collect()}
    assert got == {**Counter(("node", r["label"]) for r in nodes), **Counter(("edge", r["rel"]) for r in edges)}
    assert {(r["id"], r["seq_id"]) for r in nodes if r["id"][:2] in ("X7", "X8", "X9")} == {("X7", "X7_0"), ("X8", "X8_0"), ("X8_a_0", "X8_1"), ("X8_a_0#1", "X8_2"), ("X8_a_0#3", "X8_4"), ("X9", None)}
    assert {(r["src"], r["dst"]) for r in edges if r["src"].startswith("X8")} == {("X8_a_0", "X8"), ("X8_a_0#1", "X8_a_0"), ("X8_a_0#3", "X8_a_0#1")}
