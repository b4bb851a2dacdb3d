"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lowered(text: str) -> str:
    """``text`` with A-Z in lower case: of bytes, ``lower`` changes nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the session's ``spark.checkpoint.dir``.

    A temporary folder is set only where the session names none and runs on one
    machine, as in local tests; on a cluster its executors would not share it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillstat-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised by a reliable checkpoint in the shared folder.

    Where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, Spark deletes
    it when nothing refers to it any more; else it stays until the folder is emptied.
    What former steps left is let go first, or their shuffle files and broadcast
    tables would fill the executors, at most every other second.
    """
    shared_folder(df.sparkSession)
    release(df.sparkSession, 2.0)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of a run of many steps, written to the shared folder as Parquet and deleted when no later step needs them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            remove(self.spark, path)

    def close(self) -> None:
        remove(self.spark, self.folder)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark writes to."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_released = 0.0


def release(spark: SparkSession, seconds: float = 0.0) -> None:
    """Lets go what former steps left: Spark deletes shuffle files and broadcasts of tables that no longer exist when the driver collects its garbage, which a driver with little to do puts off for long.

    Does nothing if it was done in the last ``seconds``.
    """
    global _released
    if time.monotonic() - _released >= seconds:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released = time.monotonic()


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows; counts them, so ``df`` is best materialised."""
    return F.broadcast(df) if df.count() <= rows else df


def bounded(rows: DataFrame, key: str, most: int, size: str | None = None, most_size: int = 0) -> DataFrame:
    """About at most ``most`` of the rows of each value of ``key`` (and as many as have a sum of ``size`` of ``most_size``).

    Rows are chosen by a hash of all their columns, so the choice does not depend on
    how they are partitioned, and rare values keep all their rows at any number of others.
    """
    aggs = [F.count("*").alias("n"), *([F.sum(size).alias("m")] if size else [])]
    share = F.least(F.lit(1.0), most / F.col("n"), *([most_size / F.greatest(F.col("m"), F.lit(1))] if size else []))
    shares = rows.groupBy(key).agg(*aggs).select(key, share.alias("__share"))
    hashed = F.pmod(F.xxhash64(F.lit(1), *(F.col(f"`{c}`") for c in rows.columns)), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(if_small(cut(shares), 400_000), key).where(hashed < F.col("__share")).select(*rows.columns)


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable], rows: int | None = None, by: int | None = None, most: int = 1 << 20) -> DataFrame:
    """``mapInArrow`` with per-task state.

    ``make`` is called once a task and returns a function from a RecordBatch to
    a dict of columns; ``schema`` is the DDL of the result.  With ``rows``, batches
    are handed over in slices of at most so many rows and, of the texts or lists in
    column ``by``, of ``most`` bytes or items, to bound what Python holds.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at, n in cuts(batch.column(by), rows, most) if rows else [(0, batch.num_rows)]:
                columns = step(batch.slice(at, n))
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def cuts(column, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of parts of an Arrow column of texts or lists that hold at most so many rows and bytes or items; a longer one is alone."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.list_value_length(column) if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length(column)
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False))
    at, before = 0, 0
    while at < len(ends):
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, "right"))))
        yield at, to - at
        at, before = to, ends[to - 1]


def portions(texts, rows: int, chars: int) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of the parts of an Arrow column of texts."""
    for at, n in cuts(texts, rows, chars):
        yield at, texts.slice(at, n).to_pylist()
