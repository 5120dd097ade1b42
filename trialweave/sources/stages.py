"""Stage outputs, reports and exports.

Stages are parquet tables in the shared folder named by ``spark.checkpoint.dir``: they cut
lineage, survive the loss of executors and give the next step real file sizes to plan with.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from trialweave.sources.tables import CSV_TIME

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared stage folder of this session.

    Where the setting is absent a temporary folder is chosen, which is only right when
    driver and executors are one machine; on a cluster that is refused.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="trialweave-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_stage(df: DataFrame, root: str, name: str) -> str:
    """Write one version of a named stage and return its path.

    Every save gets its own folder, so a step may read the previous version while it writes
    the next one; the reader takes a version explicitly.
    """
    path = f"{root.rstrip('/')}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def load_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def materialize(
    df: DataFrame,
    name: str,
    path: str | None = None,
    partition_by: Sequence[str] = (),
    bucket_by: tuple[int, Sequence[str]] | None = None,
) -> DataFrame:
    """Replace a stage table (or folder, when ``path`` is given) and return a scan of it.

    ``bucket_by=(n, keys)`` lays a catalog table out by its join key, so that later joins
    on that key need no shuffle.
    """
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path is not None:
        writer.save(path)
        return df.sparkSession.read.parquet(path)
    if bucket_by is not None:
        n, keys = bucket_by
        writer = writer.bucketBy(n, *keys).sortBy(*keys)
    try:
        writer.saveAsTable(name)
    except AnalysisException as err:
        raise ValueError(f"cannot replace {name}: {err}") from err
    return df.sparkSession.table(name)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header and no row names.

    ``single_file`` is for one-screen reports of a fixed number of rows, such as a
    diagnostics row or a curve on a fixed grid; large results keep one file per partition.
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").options(timestampNTZFormat=CSV_TIME, timestampFormat=CSV_TIME).csv(path, header=True)


def export(df: DataFrame, order_by: Sequence[str], path: str, format: str = "parquet") -> None:
    """Full ordered export: a range-partitioned sort, files in key order."""
    writer = df.orderBy(*order_by).write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(path)
