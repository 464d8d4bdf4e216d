"""What several operators share: tables, staging and hash folds."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.session import shared_dir


def share_package(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package wherever the driver was started.

    On a cluster the package is installed or on ``PYTHONPATH``, which then names it already.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    own = spark.sparkContext.environment
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and root not in own.get("PYTHONPATH", "").split(os.pathsep):
        own["PYTHONPATH"] = os.pathsep.join(filter(None, [root, own.get("PYTHONPATH")]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id, text), so other columns can never clash; a null text is empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the folds; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def keep(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a table below ``spark.checkpoint.dir``, read it back; also its path."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    """Text of a public tokenizer file; its size is fixed, so tasks may get a copy.

    ``FRESHET_TOKENIZERS`` names another folder of such files.
    """
    folder = os.environ.get("FRESHET_TOKENIZERS")
    if not folder:
        import public_tokenizers

        folder = os.path.dirname(public_tokenizers.path(name))
    with open(os.path.join(folder, name), encoding="utf-8") as file:
        return file.read()


def give_back() -> None:
    """Return a Python worker's free memory to the system; workers live on between tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def in_batches(rows, schema, rows_at_once: int = 512, bytes_at_once: int = 1 << 20):
    """Record batches of (size in bytes, row as a tuple), each bounded by rows and bytes, so that no worker holds much at once."""
    import pyarrow as pa

    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if len(held) >= rows_at_once or size >= bytes_at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
