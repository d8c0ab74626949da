"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.lineage import remove_at_end


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without it (in tests) gets a temporary folder; elsewhere a folder of
    one machine would lose rows, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all machines share.")
        found = tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Executors may be lost afterwards: the rows are on shared storage, so nothing upstream is
    computed again. The session removes a checkpoint that nothing refers to any more if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table of its own in the shared folder and read it again.

    Rows may be asked for until Python ends, which removes the table.
    """
    path = remove_at_end(df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of a column and read it again: what is grouped or
    joined by the column then needs no exchange on this side."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, path = f"{name}_{uuid.uuid4().hex}", remove_at_end(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.bucketBy(buckets, column).options(path=path, compression="zstd").saveAsTable(table)
    found = spark.table(table)
    # Only the name goes: the table is external, and ``found`` knows its files and buckets.
    spark.sql(f"DROP TABLE {table}")
    return found


#: Bytes of one Arrow batch between the JVM and Python. Texts can be long, and the default of
#: 64 MB is held several times over by either side.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by BATCH_BYTES."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return what allocators keep of freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def frugal(work: Callable) -> Callable:
    """A partition function that gives freed memory back to the system when it ends.

    Workers outlive their tasks, and allocators keep what a task freed.
    """

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def free_names(df: DataFrame, n: int, *others: str) -> list[str]:
    """Names for columns that are added and dropped again: not the table's, and none of ``others``."""
    taken = {c.lower() for c in (*df.columns, *others)}
    found = (f"held_{i}" for i in itertools.count())
    return list(itertools.islice((c for c in found if c not in taken), n))


def unit_hash(seed: int, *columns) -> F.Column:
    """A reproducible number in [0, 1) from the columns' values."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
