"""Tables on shared storage, schema defaults, and staging."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from mnemo.functions.text import strings
from mnemo.schema import KNOWLEDGE


def with_defaults(df: DataFrame, schema: StructType = KNOWLEDGE) -> DataFrame:
    """Read an older table as today's: absent columns are added, NULLs get their defaults."""
    known = {f.name: f for f in df.schema.fields}
    columns = [
        F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    extra = [F.col(f"`{n}`") for n in known if n not in schema.names]
    out = df.select(*columns, *extra)
    defaults = {
        "status": F.lit("approved"),
        "source_type": F.lit("conversation"),
        "experts": strings([]),
        "expert_confidence": F.create_map().cast("map<string,double>"),
        "meta": F.create_map().cast("map<string,string>"),
    }
    for name, value in defaults.items():
        if name in schema.names:
            c = F.col(name)
            if name in ("status", "source_type"):
                c = F.nullif(c, F.lit(""))
            out = out.withColumn(name, F.coalesce(c, value))
    return out


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    """The knowledge table, read with today's schema: what an older file lacks is NULL."""
    return with_defaults(spark.read.schema(KNOWLEDGE).parquet(path))


def all_entries(table: DataFrame) -> DataFrame:
    """Every row in id order, decoded, without the vectors."""
    return with_defaults(table).drop("embedding", "embed_identity").orderBy("memory_id")


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


_own_checkpoint: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode without a setting.

    On a cluster a folder that only one machine sees would lose rows, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_checkpoint:
        _own_checkpoint.append(tempfile.mkdtemp(prefix="mnemo-"))
    return _own_checkpoint[0]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back: what several outputs need is then computed once.

    The copy lies on shared storage, so it outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SPREAD_SPLITS = 16


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when the input is a few file splits, as small files are.

    Above ``SPREAD_SPLITS`` splits a table is read in place, whatever the number of cores,
    so no more than that many splits are ever moved.
    """
    splits = df.rdd.getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(cores, 8 * SPREAD_SPLITS)) if splits < min(cores, SPREAD_SPLITS) else df
