"""Readers of landed raw files: id lists, law and act texts, JSON listings, archives, JDBC tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """id: the first word of every line that isn't blank or a remark."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(F.split(line, r"\s+")[0].alias("id")).filter("id <> ''")


def whole_texts(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """name (file name without its ending) and content of every text file."""
    reader = spark.read.option("pathGlobFilter", f"*.{extension}") if extension else spark.read
    rows = reader.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return rows.select(F.url_decode(name).alias("name"), F.col("value").alias("content"))


def listing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A landed JSON listing with a fixed schema; broken records go to _corrupt."""
    return spark.read.option("columnNameOfCorruptRecord", "_corrupt").schema(f"{schema}, _corrupt string").json(path)


def search_listing(laws: DataFrame, terms: dict[str, str] | None = None, date: str = "fecha_publicacion", start: str | None = None, end: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the laws whose fields hold all the terms within a range of dates, newest first."""
    for field, term in (terms or {}).items():
        laws = laws.filter(F.contains(F.lower(F.col(field)), F.lit(term.lower())))
    if start is not None:
        laws = laws.filter(F.col(date) >= start)
    if end is not None:
        laws = laws.filter(F.col(date) <= end)
    return laws.orderBy(F.desc(date), "identificador").offset(offset).limit(limit)


def archived_xml(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the first XML file outside META-INF of every zip archive; error where there is none."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        inner = next(n for n in z.namelist() if n.lower().endswith(".xml") and not n.startswith("META-INF"))
                        rows.append((name, z.read(inner).decode("utf-8", "replace"), None))
                except StopIteration:
                    rows.append((name, None, "no XML in archive"))
                except (zipfile.BadZipFile, RuntimeError, OSError) as e:
                    rows.append((name, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["path", "content", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInArrow(unpack, "path string, content string, error string")


def jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None, low: int = 0, high: int = 0, partitions: int = 8) -> DataFrame:
    """A relational table, read in ranges of a numeric key where one is named."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions)
    return reader.load()
