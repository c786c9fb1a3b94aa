"""Session helpers shared by all operators: reading tables, cutting lineage, checked broadcasts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Where that is unset, a session on one machine
    gets one of its own; a cluster is refused, as executors would each write to their own disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="linkloom-checkpoint-"))
    return sc.getCheckpointDir()


def spread(df: DataFrame) -> DataFrame:
    """df, a scan, on all cores where it gives fewer tasks than there are cores, as one small file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df._jdf.rdd().getNumPartitions() < cores else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def within(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows, found without reading more than max_rows + 1 of them."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it is proven to have at most max_rows rows; else df as it is, so that the join
    shuffles and adaptive execution splits its skewed partitions."""
    return F.broadcast(df) if within(df, max_rows) else df


def blank_to_null(c: Column) -> Column:
    """Null where a string has nothing but white space."""
    return F.when(F.length(F.regexp_replace(c, r"(?U)\s+", "")) > 0, c)
