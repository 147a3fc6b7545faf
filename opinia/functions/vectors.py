"""Vector helpers for MLlib input, without Python workers.

Spark SQL has no constructor for sparse vectors, but a vector column is stored as a plain struct: arrays
computed by SQL are written in that form and read back as vectors, which also cuts the lineage of
what is usually an expensive table.  Dense arrays use the JVM-side ``array_to_vector``.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array  # noqa: F401  (re-exported)
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinia.session import scratch_path


def sparse_vectors(df: DataFrame, size: int, idx: str = "idx", val: str = "val", out: str = "features") -> DataFrame:
    """``df`` with ``out``, sparse vectors of ``size`` from the columns ``idx`` (ascending indices; null: none) and ``val``,
    which go; a table in the shared checkpoint folder."""
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in (idx, val, out)]
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                      F.coalesce(F.col(idx).cast("array<int>"), F.array().cast("array<int>")).alias("indices"),
                      F.coalesce(F.col(val).cast("array<double>"), F.array().cast("array<double>")).alias("values"))
    path = scratch_path(spark, f"vectors-{uuid.uuid4().hex}")
    rows = df.select(*kept, vector.alias(out))
    rows.write.parquet(path)
    return spark.read.schema(T.StructType([*df.select(*kept).schema.fields, T.StructField(out, VectorUDT())])).parquet(path)


def dense_vector(col):
    return array_to_vector(col)
