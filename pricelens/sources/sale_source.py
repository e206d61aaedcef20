"""A source of completed sales for spark.read: landed pages as rows, one partition a file, filters at the files.

A file holds pages, one JSON object a line (info and results as in sources/pages.py), below a folder that names its feed
(<path>/<feed>/... or <path>/feed=<feed>/...). Any file system that pyarrow reads will do. Filters on feed leave out
files before they are opened; filters on the other columns are applied as rows are read. What a filter cannot express
stays with Spark. Another provider of sales is another class with the same rows.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..registry import query
from .state import shared_folder
from .tables import table

FORMAT = "landed_sales"
SCHEMA = "feed string, page int, place int, id string, status string, soldAt string, price double"
COLUMNS = ("feed", "page", "place", "id", "status", "soldAt", "price")
COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


class SaleFile(InputPartition):
    def __init__(self, feed: str, path: str):
        self.feed, self.path = feed, path


def text_or_none(value) -> str | None:
    return value if isinstance(value, str) else None if value is None else json.dumps(value)


def rows_of_page(feed: str, line: str) -> Iterator[tuple]:
    """Rows of a page that have an id; none of a line that is no page."""
    try:
        page = json.loads(line)
    except ValueError:
        return
    results = page.get("results") if isinstance(page, dict) else None
    info = page.get("info") if isinstance(page, dict) else None
    number = info.get("currentPage") if isinstance(info, dict) else None
    for place, row in enumerate(results if isinstance(results, list) else []):
        if not isinstance(row, dict):
            continue
        name = (text_or_none(row.get("id")) or "").strip(" ")
        price = row.get("price")
        if name:
            yield feed, number if isinstance(number, int) else None, place, name, text_or_none(row.get("status")), text_or_none(row.get("soldAt")), float(price) if isinstance(price, (int, float)) and not isinstance(price, bool) else None


def passes(test: Filter, value) -> bool:
    """Whether a value passes a pushed filter; a null passes none."""
    if value is None:
        return False
    if isinstance(test, IsNotNull):
        return True
    return value in test.value if isinstance(test, In) else COMPARE[type(test)](value, test.value)


class SaleReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (*COMPARE, In, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in COLUMNS:
                self.tests.append((COLUMNS.index(f.attribute[0]), f))
            else:
                yield f

    def partitions(self) -> list[SaleFile]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        files = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        made = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
                feed = f.path.rsplit("/", 2)[-2].removeprefix("feed=")
                if all(passes(t, feed) for at, t in self.tests if at == 0):
                    made.append(SaleFile(feed, f.path))
        return made

    def read(self, part: SaleFile | None) -> Iterator[tuple]:
        from pyarrow import fs

        if part is None:  # no file at all
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(part.path) as raw:
            rest = b""
            while chunk := raw.read(1 << 20):  # a file is never held whole
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    yield from self._rows(part.feed, line)
            yield from self._rows(part.feed, rest)

    def _rows(self, feed: str, line: bytes) -> Iterator[tuple]:
        for row in rows_of_page(feed, line.decode("utf-8", "replace")):
            if all(passes(t, row[at]) for at, t in self.tests):
                yield row


class LandedSales(DataSource):
    """format("landed_sales").load(path)"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SaleReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("landed_sales needs a path")
        return SaleReader(path if "://" in path or path.startswith("/") else path)


def sale_rows(spark: SparkSession, path: str) -> DataFrame:
    """All sales below a path; where() on it reaches the files."""
    spark.dataSource.register(LandedSales)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).load(path)


def land(pages: DataFrame, path: str) -> None:
    """Write pages (feed, body) as the source expects them."""
    pages.select("feed", F.col("body").alias("value")).write.partitionBy("feed").text(path)


@query("UDF-05", sql="""
select event_id::varchar as id, (event_id % 7)::varchar as feed, (event_id // 7 // 20 + 1)::int as page, value as price from events where event_id % 7 in (1, 3) and event_type = 'purchase' and value >= 40""")
def sale_source_rows(spark, sf_dir):
    """Events land as pages of seven feeds; two feeds' dear purchases are read through the source."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 7).cast("string").alias("feed"), F.floor(F.col("event_id") / 7).alias("rn"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("status"), F.col("value").alias("price"))
    page = (F.floor(F.col("rn") / 20) + 1).cast("int")
    sheets = e.groupBy("feed", page.alias("page")).agg(F.sort_array(F.collect_list(F.struct("rn", "id", "status", "price"))).alias("rows"))  # 20 rows each
    body = F.to_json(F.struct(F.struct(F.col("page").alias("currentPage")).alias("info"), F.col("rows").alias("results")))
    path = shared_folder(spark)
    land(sheets.select("feed", body.alias("body")), path)
    return sale_rows(spark, path).where("feed in ('1', '3') and status = 'purchase' and price >= 40").select("id", "feed", "page", "price")
