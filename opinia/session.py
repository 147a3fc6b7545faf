"""Session helpers: building a session, locating tables, checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def get_spark(master: str = "local[*]", partitions: int = 8, app: str = "opinia") -> SparkSession:
    """Session for tests and local runs.  On a cluster, the cluster's own
    settings win because ``getOrCreate`` reuses the running session."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting is always used when present.  Only when it is unset
    and the session runs in one process (local tests) a fresh private folder
    under the system temp dir is made; on a cluster that would be a folder
    other machines cannot see, so an unset one is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="opinia-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path inside the shared checkpoint folder for written intermediate
    tables (lineage cuts that must survive executor loss)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the parquet tables of a scale-factor folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def local_df(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small driver-side table (parameters, look-ups) as a ``LocalRelation``
    (built through Arrow), so using it never starts a Python worker."""
    import pandas as pd
    from pyspark.sql.types import _parse_datatype_string

    st = _parse_datatype_string(schema)
    rows = [tuple(r) if isinstance(r, (tuple, list)) else (r,) for r in rows]
    if not rows:
        return spark.createDataFrame([], st)
    return spark.createDataFrame(pd.DataFrame(rows, columns=st.names), schema=st)
