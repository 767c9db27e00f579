"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_FILE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file. LLM_TOKENIZER overrides the packaged one."""
    if path := os.environ.get("LLM_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        import tempfile

        path = tempfile.mkdtemp(prefix="shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


#: Rows of a file of slim rows, and of rows that carry sets or points.
SLIM, WIDE = 100_000, 5_000


def cut(df: DataFrame, rows: int | None = None, per: int = SLIM) -> DataFrame:
    """Materialise df in the shared folder: lineage ends here, and a lost executor costs no recomputation.

    rows: a bound of df's rows, where one is known. Then df has no more files (and tasks that
    write them) than one for each ``per`` rows, however many partitions a shuffle left.
    """
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per)))
    return df.checkpoint(eager=True)


def drop(*frames: DataFrame) -> None:
    """Remove the files that cut() wrote of frames that nothing reads any more, and of shuffles."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    sweep(frames[0].sparkSession)


def sweep(spark: SparkSession) -> None:
    """Collect the JVM's garbage too, so that Spark removes the files of shuffles that no plan holds; otherwise they stay until the driver's heap fills."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def crc_of_id(doc_id: str | F.Column):
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


#: Rows that a Python worker gets at once, if the session still has Spark's own setting.
BATCH_ROWS = "500"
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_ROWS, so that long texts or sets don't add up in a worker; a setting of the caller's stays."""
    if spark.conf.get(_BATCHES, None) == "10000":
        spark.conf.set(_BATCHES, BATCH_ROWS)


def give_back() -> None:
    """Hand memory that is free again back to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(run):
    """A function of batches that hands free memory back before and after it: workers serve one stage after another and would keep the most that any of them took."""

    def between(batches):
        give_back()
        yield from run(batches)
        give_back()

    return between


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns (whatever their names) never clash with the operator's own."""
    bounded_batches(df.sparkSession)
    return df.select(*[F.col(f"`{n}`") for n in names])


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
