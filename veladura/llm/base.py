"""What the operators share: shared scratch tables, the word rule and the split rule."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that driver and executors share. Where that is unset a local master,
    as in tests, gets a folder of its own; on a cluster it is an error, for no folder of one machine would do."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veladura-"))
        at = spark.sparkContext.getCheckpointDir()
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read back from the shared folder: cuts lineage and survives lost executors. Results are lazy
    and read these tables later, so that clearing the folder is up to whoever owns it, once results are written."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_of(key: Column, buckets: int) -> Column:
    """crc32 of the key as text, modulo buckets; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % buckets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df; from now on its session sends no more than `rows` rows at once to Python, since whole texts may be long.
    A smaller setting of the user's stays."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH, "10000")) <= rows:
        conf.set(BATCH, str(rows))
    return df


def text_blocks(column, size: int = 1 << 20, rows: int = 128) -> Iterator[list[str | None]]:
    """The texts of an Arrow column in blocks of about `size` characters, so that few of a batch's texts are Python
    strings at a time."""
    block, chars = [], 0
    for at in range(0, len(column), rows):
        for t in column.slice(at, rows).to_pylist():
            block.append(t)
            chars += len(t or "")
            if chars >= size:
                yield block
                block, chars = [], 0
    if block:
        yield block


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased: what bytes.lower and bytes.split do."""
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).lower().split()
