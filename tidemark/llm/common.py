"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; set a folder only where it is unset and one machine does
    all the work (tests). On a cluster a machine's own folder would be lost with it, so that is an error."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back: ``cut`` in fewer bytes."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, *keys: str) -> tuple[str, DataFrame]:
    """``df`` as Parquet in the shared checkpoint folder, one folder per value of the keys, and where it is."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*keys).parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def read_column(path: str, column: str) -> list:
    """A column of the Parquet files of a folder, read inside a task from the shared storage."""
    scheme, _, rest = path.partition(":")
    uri = path if path.startswith("/") else f"file:///{rest.lstrip('/')}" if scheme == "file" else path
    fs, at = pa.fs.FileSystem.from_uri(uri)
    files = [f.path for f in fs.get_file_info(pa.fs.FileSelector(at)) if f.base_name.endswith(".parquet")]
    return [x for f in sorted(files) for x in pq.read_table(f, columns=[column], filesystem=fs, partitioning=None).column(0).to_pylist()]


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` only, with null texts as empty ones: extra columns never reach an operator."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of stored input that one task of a shuffle is to take.
PARTITION_BYTES = 64 << 20
#: An estimate of this many bytes is none: the optimizer says so of rows that come from no file.
UNKNOWN_BYTES = 1 << 60


def partitions_for(df: DataFrame) -> int:
    """Partitions for a shuffle of what ``df`` reads: as configured, and more where its files ask for them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    held = sum(n for n in sizes if n < UNKNOWN_BYTES)
    return max(shuffle_partitions(df.sparkSession), math.ceil(held / PARTITION_BYTES))


#: Groups that the rows of a contest are dealt to before the last one.
HEATS = 64


def smallest(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows by ``order``: a task lets go ``k`` at most, a group of tasks too, and ``HEATS`` times ``k``
    meet in the end, whatever the number of tasks."""
    return smallest_of(df, k, [], *order).orderBy(*order).limit(k)


def smallest_of(df: DataFrame, k: int, keys: list[str], *order: Column) -> DataFrame:
    """``smallest`` of every key's rows, with ``_rank`` from 1."""
    heats = df.withColumn("_heat", F.pmod(F.spark_partition_id(), F.lit(HEATS)))
    for by in ([*keys, "_heat"], keys or [F.lit(0)]):
        ranked = heats.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        heats = ranked.where(F.col("_rank") <= k)
    return heats.drop("_heat")
