"""Block products and the vector index against exact search in numpy."""

import numpy as np
import pytest

from lexlake.operators import blocks, vector_index
from lexlake.operators import retrieval as ops

SF = "/root/testdata/sf0.01"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<float>")


def exact(queries, vectors, k, metric="cosine", last_id=False):
    out = []
    for q, x in enumerate(queries):
        s = blocks.scores(np.array([x], np.float32).astype(float), np.array(vectors, np.float32).astype(float), metric)[0]
        order = sorted((i for i in range(len(s)) if not np.isnan(s[i])), key=lambda i: (-s[i], -i if last_id else i))[:k]
        out += [(q, i, r + 1) for r, i in enumerate(order)]
    return out


def rows(df):
    return sorted((r["query_no"], r["id"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_block_products(spark, monkeypatch, metric):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8)).round(1)
    vectors[40:60] = vectors[0]
    vectors[7] = 0
    queries = np.concatenate((vectors[:25], rng.normal(size=(5, 8))))
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 7)
    monkeypatch.setattr(blocks, "VECTOR_BLOCK", 50)
    asked = frame(spark, queries).selectExpr("0 AS key", "id AS query_no", "vector")
    seen = frame(spark, [*vectors, None]).selectExpr("0 AS key", "id", "vector")
    for last in (False, True):
        want = exact(queries, vectors, 6, metric, last)
        assert rows(blocks.nearest(asked, seen, 6, metric, last)) == sorted(want)
    assert rows(blocks.nearest(asked.limit(0), seen, 6)) == [] and rows(blocks.nearest(asked, seen.limit(0), 6)) == []


def test_index_is_exact_and_recalls(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    queries = table.filter("id % 25 = 0").selectExpr("id AS query_no", "vector")
    want = rows(ops.many_queries(table, queries, 10, vector="vector"))
    path = str(tmp_path / "index")
    vector_index.create(table.filter("id % 3 > 0"), path)
    vector_index.add(table.filter("id % 3 = 0"), path)
    assert spark.read.parquet(f"{path}/lists").count() == table.count()
    assert rows(vector_index.search(queries, path, 10, 3, exact=True)) == want
    lists = len(vector_index.centroids_of(spark, path))
    near = rows(vector_index.search(queries, path, 10, lists * 3 // 4 + 1))
    recall = len({r[:2] for r in near} & {r[:2] for r in want}) / len(want)
    assert recall >= 0.9
    plan = spark.read.parquet(f"{path}/lists").filter("list IN (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan
    with pytest.raises(FileExistsError):
        vector_index.create(table, path)
    assert vector_index.drop(spark, path) and not vector_index.drop(spark, path)


def test_registered_index_recalls(spark):
    from lexlake import registry

    want = {(r["query_no"], r["id"]) for r in registry.queries()["index_topk"](spark, SF).collect()}
    got = {(r["query_no"], r["id"]) for r in registry.queries()["index_probe"](spark, SF).collect()}
    assert len(want & got) / len(want) >= 0.9


def test_odd_vectors(spark, tmp_path):
    path = str(tmp_path / "index")
    same = frame(spark, [[1, 0]] * 30 + [None, [0, 0], [0, 1]])
    vector_index.create(same, path, lists=4)
    found = rows(vector_index.search(frame(spark, [[1, 0], [0, 0], None]).selectExpr("id AS query_no", "vector"), path, 3, 1, exact=True))
    assert found == [(0, 0, 1), (0, 1, 2), (0, 2, 3)]
    empty = str(tmp_path / "empty")
    vector_index.create(same.limit(0), empty)
    assert vector_index.search(frame(spark, [[1, 0]]).selectExpr("id AS query_no", "vector"), empty, 3, 1).count() == 0
