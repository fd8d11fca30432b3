"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts may be long, so batches are kept short.
BATCH_ROWS = 1000


def arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short enough for long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def lean(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a partition's batches that gives freed memory back to the system at its end. Python workers live on from task to task."""

    def run(batches: Iterator) -> Iterator:
        yield from each(batches)
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset in local mode (tests); else an error."""
    path = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="weft-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weft-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_own_names(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns of df (values) under internal names (keys), so that clashing extra columns cannot interfere."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores after it until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
