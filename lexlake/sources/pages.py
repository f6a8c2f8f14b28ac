"""A listing that was landed page by page, as a data source: pages are read in parallel, and filters are applied where pages are read.

    <path>/page=<n>/part-*.txt   one JSON answer for each page: {"offset": ..., "limit": ..., "total": ..., "data": [{...}, ...]}

``spark.read.format("landed_listing").option("path", ...).schema(...)`` has one partition for each page; ``offset`` and ``limit`` options narrow the pages to
those that hold the rows asked for. Equality, comparison, IN and null filters reach the reader when ``register`` has switched that on.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def _passes(row: dict, f: Filter) -> bool:
    value = row.get(f.attribute[0])
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    return value in f.value if isinstance(f, In) else _COMPARE[type(f)](value, f.value)


@dataclass
class Page(InputPartition):
    """One page's files, and the rows of it that are asked for."""

    number: int
    files: list[str]
    first: int
    end: int | None


class PageReader(DataSourceReader):
    """Reads the pages of a folder; each is a partition."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.filters = schema, options, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            known = type(f) in _COMPARE or isinstance(f, (EqualNullSafe, In, IsNull, IsNotNull))
            if known and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Page]:
        store, root = fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] or self.options["path"].startswith("file:") else (fs.LocalFileSystem(), self.options["path"])
        pages: dict[int, list[str]] = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.is_file and info.size and (at := re.search(r"/page=(\d+)/part-[^/]*$", info.path)):
                pages.setdefault(int(at[1]), []).append(info.path)
        offset, limit = int(self.options.get("offset", 0)), self.options.get("limit")
        end = None if limit is None else offset + int(limit)
        size = int(self.options.get("pagesize", 0))
        found = []
        for n in sorted(pages):
            # with the page's size known, pages that lie outside aren't opened
            if size and ((end is not None and n * size >= end) or (n + 1) * size <= offset):
                continue
            found.append(Page(n, sorted(pages[n]), offset, end))
        return found or [Page(-1, [], 0, 0)]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        path = self.options["path"]
        store = fs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else fs.LocalFileSystem()
        names = self.schema.names
        for name in page.files:
            with store.open_input_stream(name) as f:
                answer = json.loads(f.read())
            rows = [r for i, r in enumerate(answer["data"], answer["offset"]) if i >= page.first and (page.end is None or i < page.end)]
            rows = [{k: r.get(k) for k in names} for r in rows if all(_passes(r, f) for f in self.filters)]
            yield from pa.Table.from_pylist(rows, to_arrow_schema(self.schema)).to_batches()


class LandedListing(DataSource):
    """The source's name and its reader."""

    @classmethod
    def name(cls) -> str:
        return "landed_listing"

    def schema(self) -> str:
        return "identificador string, titulo string, fecha_publicacion string"

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedListing)


def land(rows: DataFrame, path: str, order: list[str], limit: int = 1000) -> None:
    """Write rows as the pages that a listing of so many a page, in an order, would have answered.

    Rows are numbered by ranges of the order whose sizes are added up, so no task sees more than its range.
    """
    from lexlake.session import checkpointed

    ranged = rows.repartitionByRange(*order, F.xxhash64(*rows.columns)).sortWithinPartitions(*order, F.xxhash64(*rows.columns))
    ranged = checkpointed(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    sizes = ranged.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    placed = ranged.join(F.broadcast(sizes), F.shiftright("_at", 33) == F.col("_part")).withColumn("_row", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    total = rows.count()
    item = F.struct("_row", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))
    pages = placed.groupBy(F.expr(f"_row div {limit}").alias("page")).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    data = F.array_join(F.transform("rows", lambda r: r["json"]), ",")
    answer = F.concat(F.lit('{"offset":'), F.col("page") * limit, F.lit(f',"limit":{limit},"total":{total},"data":['), data, F.lit("]}"))
    pages.select("page", answer.alias("value")).write.mode("overwrite").partitionBy("page").text(path)
