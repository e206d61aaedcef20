"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the controls from tab to carriage return.
WORD = re.compile("[^ \t-\r]+")
#: The same for Java's and DuckDB's regular expressions.
WORD_SQL = r"[^\x20\x09-\x0D]+"


_HELD: dict = {}


def in_worker(key: str, make):
    """What make() returned in this Python process the first time; the latest few keys are held across tasks."""
    if key not in _HELD:
        while len(_HELD) > 1:
            _HELD.pop(next(iter(_HELD)))
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Give back what in_worker holds: for tasks that use none of it, in a worker that ran another stage before."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one where that is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pricelens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, times: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * times


def id_remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id's decimal text, modulo `by`; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(by))


def slices(texts: list, limit: int = 2 << 20):
    """Ranges of consecutive texts of about `limit` characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def sliced(batches, at: int, limit: int = 1 << 20):
    """Slices of consecutive rows whose texts (column `at`, or its bytes) take about `limit` bytes together.

    Python strings are made of one slice at a time, and what a batch took is given back before the next one.
    """
    for batch in batches:
        start = size = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
            size += n
            if size >= limit:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch
        pa.default_memory_pool().release_unused()


def with_columns(df: DataFrame, make, fields: str, text: str = "text", limit: int = 1 << 20) -> DataFrame:
    """Every row of df with the columns that make(list of texts) returns for it.

    make gets a run of consecutive texts (nulls included) of about `limit` bytes and returns one
    list or array for each of the fields, a DDL string. The fields replace columns of the same name.
    """
    schema = df.sparkSession.createDataFrame([], fields).schema
    names = schema.fieldNames()
    rest = [c for c in df.columns if c not in names]
    out = df.select(*[F.col(f"`{c}`") for c in rest]).schema
    for f in schema:
        out = out.add(f)
    at = rest.index(text)

    def run(batches):
        for part in sliced(batches, at, limit):
            made = make(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, pa_type) for x, pa_type in zip(made, types)]], [*rest, *names])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema]
    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, out)
