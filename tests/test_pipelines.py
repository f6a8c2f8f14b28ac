"""Bucketed tables, recorded runs, landed listings, acts as table functions, and the ingest stream: failures, replays, odd input."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lexlake.operators import bucketed, migrations, runs
from lexlake.sources import acts, pages
from lexlake.streaming import ingest
from tests.test_golden import LAW


def cells(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_bucketed_merge_rewrites_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(500).selectExpr("id", "concat('n', id) AS name", "1 AS x")
    assert bucketed.create(rows, path, ["id"], 16) == 1
    before = json.loads((tmp_path / "t/manifest/0000000001.json").read_text())["files"]
    touched = bucketed.merge(spark.createDataFrame([(7, "seven"), (7, "late"), (7, None)], "id long, name string"), path)
    after = json.loads((tmp_path / "t/manifest/0000000002.json").read_text())["files"]
    assert len(touched) == 1 and {b for b in before if before[b] != after[b]} == {str(touched[0])}
    assert cells(bucketed.read(spark, path).filter("id = 7")) == [(7, "seven", None)] and cells(bucketed.read(spark, path, 1).filter("id = 7")) == [(7, "n7", 1)]
    bucketed.merge(spark.createDataFrame([(8, None, 5), (None, "nothing", 2)], "id long, name string, y int"), path, properties=True)
    assert cells(bucketed.read(spark, path).filter("id = 8 OR id IS NULL")) == [(8, "n8", 1, 5), (None, "nothing", None, 2)]
    bucketed.merge(rows.limit(0), path, gone=spark.createDataFrame([(None,), (9,)], "id long"))
    assert bucketed.read(spark, path).count() == 499 and bucketed.lookup(spark, path, spark.createDataFrame([(8,), (9,)], "id long")).count() == 1
    assert bucketed.merge(rows.limit(0), path) == [] and bucketed.versions(spark, path) == [1, 2, 3, 4]
    with pytest.raises(FileExistsError):
        bucketed.create(rows, path, ["id"])
    with pytest.raises(FileNotFoundError):
        bucketed.read(spark, str(tmp_path / "none"))


def test_a_merge_that_fails_or_comes_second_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    bucketed.create(spark.range(50).selectExpr("id", "1 AS x"), path, ["id"], 4)
    new = spark.createDataFrame([(3, 9)], "id long, x int")
    commit = bucketed._committed
    monkeypatch.setattr(bucketed, "_committed", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        bucketed.merge(new, path)
    assert bucketed.read(spark, path).filter("x = 9").count() == 0

    def late(s, p, version, manifest):
        commit(s, p, version, manifest | {"files": {}})
        commit(s, p, version, manifest)

    monkeypatch.setattr(bucketed, "_committed", late)
    with pytest.raises(bucketed.Conflict):
        bucketed.merge(new, path)
    monkeypatch.setattr(bucketed, "_committed", commit)
    assert bucketed.read(spark, path).count() == 0 and bucketed.read(spark, path, 1).count() == 50
    assert bucketed.vacuum(spark, path) >= 4 and bucketed.versions(spark, path) == [2]


def test_runs_go_on_where_they_failed(spark, tmp_path):
    made = []

    def step(name, make):
        return runs.Step(name, lambda d: (made.append(name), make(d))[1])

    steps = [step("even", lambda d: d.filter("id % 2 = 0")), step("half", lambda d: d.selectExpr("id div 2 AS id")), step("few", lambda d: d.filter("id < 10"))]
    bad = [*steps[:2], step("few", lambda d: d.selectExpr("assert_true(id < 5)"))]
    path = str(tmp_path)
    with pytest.raises(runs.StepFailed, match="few"):
        runs.run(spark.range(100), bad, path, "r")
    assert runs.run(spark.range(100), steps, path, "r").count() == 10
    assert made == ["even", "half", "few", "few"]
    got = [(r["place"], r["step"], r["status"], r["rows_in"], r["rows_out"], r["error"] is None) for r in runs.record(spark, path).orderBy("place", F.desc("status")).collect()]
    assert got == [(0, "even", "done", None, 50, True), (1, "half", "done", 50, 50, True), (2, "few", "failed", 50, None, False), (2, "few", "done", 50, 10, True)]
    assert runs.run(spark.range(100), steps, path, "r").count() == 10 and len(made) == 4
    (t,) = runs.totals(runs.record(spark, path)).collect()
    assert (t["steps"], t["failed"], t["rows_out"]) == (3, 1, 10)
    with pytest.raises(ValueError):
        runs.run(spark.range(1), steps[:1] * 2, path, "x")


def test_landed_pages(spark, tmp_path):
    rows = spark.range(95).selectExpr("id", "if(id % 10 = 0, null, concat('t\"é', id % 3)) AS t", "cast(id as double) / 2 AS v")
    path = str(tmp_path / "p")
    pages.land(rows, path, ["id"], 20)
    assert sorted(x for x in os.listdir(path) if x.startswith("page=")) == [f"page={k}" for k in range(5)]
    pages.register(spark)
    reader = lambda: spark.read.format("landed_listing").schema("id long, t string, v double").option("path", path)
    all_ = reader().load()
    assert cells(all_) == cells(rows) and all_.rdd.getNumPartitions() == 5
    for f in ("id = 7", "v >= 20 AND v < 22", "t IS NULL", "t IN ('t\"é1', 'x')", "t <=> NULL", "id % 2 = 0", "t > 't\"é0' AND id <= 30", "v <> 3"):
        assert cells(all_.filter(f)) == cells(rows.filter(f)), f
    some = reader().option("offset", 35).option("limit", 20).option("pageSize", 20).load()
    assert some.rdd.getNumPartitions() == 2 and [r["id"] for r in some.orderBy("id").collect()] == list(range(35, 55))
    pages.land(rows.limit(0), str(tmp_path / "e"), ["id"], 20)
    assert spark.read.format("landed_listing").schema("id long").option("path", str(tmp_path / "e")).load().count() == 0


def test_acts_of_odd_shapes(spark):
    acts.register(spark)
    rows = [(1, None), (2, ""), (3, "<ACT><TITLE"), (4, "<p class='oj-ti-art'>Artículo 1</p>"), (5, " <?xml version='1.0'?><ACT><BIB><NO.DOC>7</NO.DOC></BIB><VISA>Visto 32016R0679,</VISA></ACT>"), (6, "TIPO: X\n\n[CAPITULO] I\n")]
    df = spark.createDataFrame(rows, "i int, content string")
    got = {p: cells(spark.sql(f"SELECT i, r.* FROM {{df}}, LATERAL act_rows(content, '{p}') r", df=df)) for p in acts.SCHEMAS}
    assert [(i, kind) for i, _, kind, _ in got["lines"]] == [(3, "error"), (4, "article"), (5, "text"), (6, "title"), (6, "heading")]
    assert got["metadata"] == [(5, "number", "7"), (6, "tipo", "X")] and got["basis"] == [(5, 0, "Visto 32016R0679,", "32016R0679")]
    with pytest.raises(Exception, match="part must be one of"):
        spark.sql("SELECT * FROM {df}, LATERAL act_rows(content, 'other')", df=df)


def test_ingest_killed_and_started_again(spark, tmp_path):
    inbox, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for k in range(3):
        spark.createDataFrame([(f"L{k}", LAW.format(id=f"L{k}")), (f"bad{k}", "<x")], ingest.LANDED).coalesce(1).write.mode("append").json(inbox)

    def killed(number):
        if number == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        ingest.ingest(ingest.landed(spark, inbox, 1), out, checkpoint, killed).awaitTermination()
    seen = {r["id"] for r in ingest.table(spark, out, "nodes").filter("label = 'normativa'").collect()}
    assert len(seen) == 1
    ingest.ingest(ingest.landed(spark, inbox, 1), out, checkpoint).awaitTermination()
    once = str(tmp_path / "once")
    ingest.saved(spark.read.schema(ingest.LANDED).json(inbox), 0, once)
    for name in ("nodes", "edges"):
        assert cells(ingest.table(spark, out, name)) == cells(ingest.table(spark, once, name))
    ingest.ingest(ingest.landed(spark, inbox, 1), out, checkpoint).awaitTermination()
    assert ingest.table(spark, out, "nodes").filter("label = 'normativa'").count() == 3


def test_migrations_in_order_and_once(spark, tmp_path):
    path = str(tmp_path / "m")
    migrations.create(spark.range(10).toDF("a"), path)
    one, two = migrations.Migration(1, "rename", lambda d: d.toDF("b")), migrations.Migration(2, "half", lambda d: d.filter("b < 5"))
    broken = migrations.Migration(2, "half", lambda d: d.selectExpr("assert_true(b < 0)"))
    with pytest.raises(Exception, match="assert|is not true"):
        migrations.apply(spark, path, [one, broken])
    assert migrations.read(spark, path).columns == ["b"] and migrations.read(spark, path).count() == 10
    assert migrations.apply(spark, path, [two, one]) == [2] and migrations.apply(spark, path, [one, two]) == []
    assert migrations.read(spark, path).count() == 5 and [r["number"] for r in migrations.record(spark, path).collect()] == [0, 1, 2]
    for wrong in ([two], [one, migrations.Migration(2, "other", two.change)], [one], [one, two, migrations.Migration(4, "gap", two.change)]):
        with pytest.raises(ValueError):
            migrations.apply(spark, path, wrong)


def test_times_to_the_nearest_millisecond(spark):
    from lexlake.plans.pipelines import nearest_millisecond

    given = ["2024-01-01 00:00:09.999499", "2024-01-01 00:00:09.9995", "1969-12-31 23:59:59.9985", None]
    rows = spark.createDataFrame([(t,) for t in given], "t string").select(nearest_millisecond(F.col("t").cast("timestamp")).cast("string").alias("t"))
    assert [r["t"] for r in rows.collect()] == ["2024-01-01 00:00:09.999", "2024-01-01 00:00:10", "1969-12-31 23:59:59.998", None]


def test_versions_of_a_batch_are_worked_out_once(spark, tmp_path, monkeypatch):
    calls, real = spark.sparkContext.accumulator(0), ingest.law_tree.article_versions
    counted = F.udf(lambda x: (calls.add(1), x)[1]).asNondeterministic()
    monkeypatch.setattr(ingest.law_tree, "article_versions", lambda lines: real(lines).withColumn("name", counted("name")))
    batch = spark.createDataFrame([("L1", LAW.format(id="L1"))], "law_id string, xml string")
    ingest.saved(batch, 0, str(tmp_path))
    assert calls.value == real(ingest.law_tree.distributed(ingest.laws.law_lines(batch))).count() > 1


def test_python_gets_few_laws_at_a_time(spark):
    from lexlake.sources import laws

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    laws.law_lines(spark.createDataFrame([("L1", LAW.format(id="L1"))], "law_id string, xml string"))
    assert int(spark.conf.get(key)) == laws.TEXTS
    spark.conf.set(key, before)


def test_what_many_cite_is_looked_up_once(spark, monkeypatch):
    from lexlake.operators import linking

    asked, real = [], linking.valid_at
    monkeypatch.setattr(linking, "valid_at", lambda left, *rest: (asked.append(left.count()), real(left, *rest))[1])
    rows = [(f"L{i}_a1_0", f"L{i}", "1", "Según el art. 14 CE y el artículo 2 de esta ley.") for i in range(50)] + [("BOE-A-1978-31229_14", "BOE-A-1978-31229", "14", "")]
    own = spark.createDataFrame(rows, "article_id string, law_id string, clean_number string, full_text string")
    own = own.withColumns({"valid_from": F.lit("1990-01-01").cast("timestamp_ntz"), "valid_to": F.lit(None).cast("timestamp_ntz")})
    old = own.withColumn("valid_from", F.when(F.col("law_id").startswith("BOE"), F.lit("1978-12-29").cast("timestamp_ntz")).otherwise(F.col("valid_from")))
    got = cells(linking.linked(linking.extracted(own), old).select("src", "dst"))
    assert got == sorted([(f"L{i}_a1_0", d) for i in range(50) for d in ("BOE-A-1978-31229_14", f"L{i}")], key=repr)
    assert asked == [51]
