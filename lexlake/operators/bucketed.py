"""Keyed tables in hash buckets, with a manifest for each version: a merge rewrites the buckets that its keys fall into.

    <path>/data/<version>-<token>/bucket=<n>   Parquet files of one bucket as one write left it
    <path>/manifest/<version>.json             key, number of buckets, schema, and for each bucket the folder that holds it

A version is there once its manifest is, which is put in place by one rename; a reader takes the newest manifest and sees its version whole, or
an older one. Untouched buckets are named again by the next manifest, not copied. Two merges into one version: the one that comes second fails, and its
data are never named. Keys are compared as values are, nulls included; of several new rows with one key one counts, the greatest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer made the version first."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are there, ascending."""
    fs, at = _fs(spark, f"{path}/manifest")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, path: str, version: int | None) -> tuple[int, dict]:
    there = versions(spark, path)
    if not there or version is not None and version not in there:
        raise FileNotFoundError(f"{path}: no version {version if version is not None else 'at all'}")
    version = there[-1] if version is None else version
    (row,) = spark.read.text(f"{path}/manifest/{version:010d}.json", wholetext=True).collect()
    return version, json.loads(row[0])


def _committed(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    fs, final = _fs(spark, f"{path}/manifest/{version:010d}.json")
    _, held = _fs(spark, f"{path}/manifest/_{uuid.uuid4().hex}")
    out = fs.create(held, False)
    out.write(json.dumps(manifest).encode())
    out.close()
    if fs.exists(final) or not fs.rename(held, final):
        fs.delete(held, False)
        raise Conflict(f"{path}: version {version} was made by another writer")


def _with_bucket(rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def _one_each(rows: DataFrame, key: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_row")).select(*key, "_row.*")


def _data(rows: DataFrame, path: str, version: int) -> str:
    at = f"data/{version}-{uuid.uuid4().hex[:8]}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{at}")
    return at


def create(rows: DataFrame, path: str, key: list[str], buckets: int = 64) -> int:
    """A table of rows, one for each key, at a path without one. Returns its version, 1."""
    if versions(rows.sparkSession, path):
        raise FileExistsError(path)
    rows = _one_each(rows, key)
    at = _data(_with_bucket(rows, key, buckets), path, 1)
    found = _buckets_in(rows.sparkSession, f"{path}/{at}")
    manifest = {"key": key, "buckets": buckets, "schema": rows.schema.jsonValue(), "files": {str(b): f"{at}/bucket={b}" for b in found}}
    _committed(rows.sparkSession, path, 1, manifest)
    return 1


def _buckets_in(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))


def _rows(spark: SparkSession, path: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    files = [f for b, f in manifest["files"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in files]) if files else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or a given one."""
    return _rows(spark, path, _manifest(spark, path, version)[1])


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The rows of some keys, read from their buckets alone."""
    _, manifest = _manifest(spark, path, None)
    touched = [r[0] for r in _with_bucket(keys.select(*manifest["key"]), manifest["key"], manifest["buckets"]).select("bucket").distinct().collect()]
    return _rows(spark, path, manifest, touched).join(keys.select(*manifest["key"]).distinct(), manifest["key"], "left_semi")


def merge(new: DataFrame, path: str, gone: DataFrame | None = None, properties: bool = False) -> list[int]:
    """Put rows in by key and take the keys of ``gone`` out, in one new version; returns the buckets that were rewritten.

    A new row replaces the old one; with ``properties`` only its non-null values do, and the others stay. New columns are added to the table.
    """
    spark = new.sparkSession
    version, manifest = _manifest(spark, path, None)
    key, buckets = manifest["key"], manifest["buckets"]
    old_schema = StructType.fromJson(manifest["schema"])
    names = list(dict.fromkeys([*old_schema.names, *new.columns]))
    types = {f.name: f.dataType for f in [*new.schema.fields, *old_schema.fields]}
    new = _one_each(new.select(*[F.col(c).cast(types[c]) if c in new.columns else F.lit(None).cast(types[c]).alias(c) for c in names]), key)
    # the number of buckets bounds what is collected
    touched = _with_bucket(new.select(*key), key, buckets).select("bucket")
    if gone is not None:
        touched = touched.unionByName(_with_bucket(gone.select(*key), key, buckets).select("bucket"))
    touched = sorted(r[0] for r in touched.distinct().collect())
    if not touched:
        return []
    old = _rows(spark, path, manifest, touched)
    same = None
    for k in key:
        on = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        same = on if same is None else same & on
    both = old.withColumn("_o", F.lit(True)).alias("o").join(new.withColumn("_n", F.lit(True)).alias("n"), same, "full")
    from_new = F.col("n._n").isNotNull()

    def value(c: str):
        if c not in old_schema.names:
            return F.col(f"n.{c}").alias(c)
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        return (F.when(from_new & (F.lit(not properties) | b.isNotNull() | F.lit(c in key)), b).otherwise(a)).alias(c)

    rows = both.select(*[value(c) for c in names])
    if gone is not None:
        left = gone.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(key)]).distinct()
        on = None
        for i, k in enumerate(key):
            here = F.col(k).eqNullSafe(F.col(f"_g{i}"))
            on = here if on is None else on & here
        rows = rows.join(left, on, "left_anti")
    at = _data(_with_bucket(rows, key, buckets), path, version + 1)
    written = _buckets_in(spark, f"{path}/{at}")
    files = {b: f for b, f in manifest["files"].items() if int(b) not in touched} | {str(b): f"{at}/bucket={b}" for b in written}
    schema = StructType([StructType([]).add(c, types[c])[0] for c in names])
    _committed(spark, path, version + 1, manifest | {"schema": schema.jsonValue(), "files": files})
    return touched


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` versions and the folders that no kept one names, those of failed writes too; returns how many folders went. For
    when nobody writes, or reads an older version."""
    there = versions(spark, path)
    fs, _ = _fs(spark, path)
    named: set[str] = set()
    for v in there[-keep:]:
        named |= set(_manifest(spark, path, v)[1]["files"].values())
    for v in there[:-keep]:
        fs.delete(_fs(spark, f"{path}/manifest/{v:010d}.json")[1], False)
    went = 0
    for write in fs.listStatus(_fs(spark, f"{path}/data")[1]):
        name = write.getPath().getName()
        for b in _buckets_in(spark, f"{path}/data/{name}"):
            if f"data/{name}/bucket={b}" not in named:
                fs.delete(_fs(spark, f"{path}/data/{name}/bucket={b}")[1], True)
                went += 1
    return went
