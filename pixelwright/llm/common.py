"""Shared helpers of the training-data operators.

Every operator takes a DataFrame plus column names, so extra columns with any name may
be present: the first step always projects the wanted columns under private names.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; the path is only ever opened by Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with only ``new=old`` columns, whatever else it holds."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def utf8(column: str) -> Column:
    """A string column as its UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``: the fixed train/held-out split."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


#: Bytes of a text that are cut into words at once, so that lists of words stay small for texts of any length.
PART = 1 << 22
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def text_parts(data: bytes, size: int | None = None) -> Iterator[bytes]:
    """The text in parts that end before an ASCII blank, so that no word is cut."""
    start, size = 0, size or PART
    while len(data) - start > size:
        m = _BLANK.search(data, start + size)
        end = m.start() if m else len(data)
        yield data[start:end]
        start = end
    if not start or start < len(data):
        yield data[start:]


def hash_sample(df: DataFrame, key: str, limit: int, total: int) -> DataFrame:
    """The ``limit`` rows with the smallest hashes of their keys, of about ``total`` rows.

    A threshold on the hash leaves about twice as many rows before anything is sorted, so no
    task hands on ``limit`` rows of its own, however many tasks there are.
    """
    share = min(1.0, 2.0 * limit / max(1, total))
    hashed = df.withColumn("_h", F.xxhash64(F.col(key)))
    if share < 1:
        hashed = hashed.where(F.col("_h") <= F.lit(int(-(2**63) + share * 2**64)))
    return hashed.orderBy("_h", key).limit(limit).drop("_h")


#: Rows of texts that go to a Python worker at once; the planner's default of 10,000 is for narrow rows.
BATCH_ROWS = 1000


def lean(spark: SparkSession) -> None:
    """Smaller Arrow batches for the stages that hand whole texts to Python, unless the session sets its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


#: Rows of texts that Spark's Parquet reader holds at once in each task, and bytes of input of a task, whose rows
#: a Parquet writer may hold until the task ends; the planner's defaults of 4,096 rows and 128 MB are for narrow rows.
READ_ROWS, TASK_BYTES = 256, "32m"


def lean_reads(spark: SparkSession) -> None:
    """Less memory a task for stages that read and write whole texts, unless the session sets its own."""
    for name, usual, value in (("spark.sql.parquet.columnarReaderBatchSize", "4096", str(READ_ROWS)), ("spark.sql.files.maxPartitionBytes", "134217728b", TASK_BYTES)):
        if spark.conf.get(name) == usual:
            spark.conf.set(name, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or (local tests) a temporary one.

    A local master has one machine only, so a temporary folder is shared by definition;
    any other master must name the folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    global _LOCAL
    if _LOCAL is None:
        folder = tempfile.mkdtemp(prefix="pixelwright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL = "file://" + folder
    return _LOCAL


_LOCAL: str | None = None


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts the lineage, survives lost executors (the files are not on any executor)
    and lets several consumers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_files(df: DataFrame) -> None:
    """Remove the files behind a materialized intermediate that nothing reads any more."""
    spark = df.sparkSession
    for root in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's vocabulary file is on this machine."""
    folder = os.environ.get("PUBLIC_TOKENIZERS", "")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
