"""What the operators share: tables, files in the shared folder, and texts as byte buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators._shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir."""
    return f"{shared_folder(spark)}/depweave-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and any executor may be lost."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, nulls_first: bool) -> tuple[DataFrame, str, bool]:
    """docs with a number of each row in the order of doc_id, that column's name, and whether it is the doc_id itself: so if none is null or repeated.

    Otherwise rows are sorted, numbered and written; null ids come first or last, and rows of equal id in the order of their texts.
    """
    own, name, place = F.col("doc_id").cast("long"), fresh(docs, "_row"), fresh(docs, "_place")
    most = docs.groupBy(own.alias("id")).count().agg(F.max("count").alias("n"), F.max(F.col("id").isNull()).alias("nulls")).first()
    if (most["n"] or 1) == 1 and not most["nulls"]:
        return docs.withColumn(name, own), name, True
    order = F.asc_nulls_first("doc_id") if nulls_first else F.asc_nulls_last("doc_id")
    rows = docs.withColumn(place, F.monotonically_increasing_id()).orderBy(order, "text", place).drop(place)
    return materialise(rows.withColumn(name, F.monotonically_increasing_id())), name, False


def fresh(docs: DataFrame, name: str) -> str:
    """A column name like `name` that docs has not got."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def hot_join(rows: DataFrame, one: DataFrame, keys: list[str], n: str, total: int, share: int = 4096) -> DataFrame:
    """rows.join(one, keys, "left"), `one` having a row for each key and `n`, the number of rows with it, of `total` in all.

    A key with more than 1 / `share` of all rows could fill a task; fewer than `share` keys can have so many, so these are broadcast.
    """
    hot = F.broadcast(one.where(F.col(n) * share > total))
    cold = rows.join(hot.select(keys), keys, "left_anti").join(one.where(F.col(n) * share <= total), keys, "left")
    return rows.join(hot, keys).unionByName(cold)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column and where each starts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
