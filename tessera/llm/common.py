"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; only where the session has none (tests) is one made."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    elif named and not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of the frame has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def id_field(df: DataFrame, name: str, to: str = "doc_id") -> T.StructField:
    """The id column's field under the name that an operator's output has."""
    return T.StructField(to, df.schema[name].dataType, True)


#: Input batches after which a worker's freed memory goes back at once.
RELEASED_BYTES = 8_000_000


def release_memory() -> None:
    """Hands freed memory back to the system: a Python worker stays for later tasks beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def releasing(f: Callable) -> Callable:
    """The mapInArrow function f, with freed memory handed back when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release_memory()

    return run


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """mapInArrow by a function that yields dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in f(batch):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c := columns[x.name], pa.Array) and c.type == x.type else pa.array(c, x.type) for x in out], schema=out
                )
            if batch.nbytes >= RELEASED_BYTES:
                release_memory()

    return df.mapInArrow(releasing(run), schema)


def row_key(*columns: str | Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns: a row's identity where ids may repeat or be null.

    Rows with equal columns get equal keys, which is what operators whose result depends on these
    columns alone need.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    salted = [F.lit(0x5EED), *reversed(cols)]
    return [F.xxhash64(*cols, *[c.isNull() for c in cols]).alias("k1"), F.xxhash64(*salted).alias("k2")]


def held_out(column: str, modulus: int, remainder: int = 2) -> Column:
    """crc32(id as text) mod modulus = remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def stored_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the frame's size, which for a file scan is the size of its files.

    Where Spark knows no size (frames that are not of files get a default near 2**63), the strings are measured.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 56:
        return size
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)).cast("long") for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.agg(F.sum(sum(texts, F.lit(8)))).first()[0] or 0
