"""A table that a stream updates and readers always see whole.

Each micro-batch writes its changed rows into a folder of its own and then adds one manifest, a single
small file, that lists the folders which make up the table from then on.  A file appears by a rename, so a
manifest is there or not; a reader takes the latest one and, of each key, the row of the latest folder.  A batch
that is run again after a crash finds its manifest and adds nothing, or finds none and writes new folders;
what a lost attempt has left is in no manifest.  Every ``COMPACT`` batches the table is written as one folder."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

COMPACT = 20
FOLDERS, MANIFESTS = "rows", "manifests"


def manifest(spark: SparkSession, path: str, epoch: int | None = None) -> dict | None:
    """The latest manifest (or that of one batch), None if there is none."""
    try:
        found = spark.read.schema("value string").text(os.path.join(path, MANIFESTS), recursiveFileLookup=True)
        rows = found.select(F.get_json_object("value", "$.epoch").cast("long").alias("e"), "value")
        rows = rows.where(F.col("e") == epoch) if epoch is not None else rows
        last = rows.agg(F.max_by("value", "e")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return json.loads(last) if last else None


def _merged(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Of each key the row of the last part that has it."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rest = [c for c in out.columns if c not in (*keys, "_at")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_at").alias("_r")).select(*keys, "_r.*")


def _parts(spark: SparkSession, path: str, folders: list[str], schema: T.StructType) -> list[DataFrame]:
    return [spark.read.schema(schema).parquet(os.path.join(path, FOLDERS, f)).withColumn("_at", F.lit(i)) for i, f in enumerate(folders)]


def read(spark: SparkSession, path: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """The table as of the latest whole batch; empty before the first one."""
    last = manifest(spark, path)
    if last is None:
        return spark.createDataFrame([], schema)
    return _merged(_parts(spark, path, last["folders"], schema), keys).select(*schema.names)


def update(batch: DataFrame, epoch: int, path: str, keys: list[str], compact: int = COMPACT) -> None:
    """Sink for ``foreachBatch`` in update mode: ``batch`` has the new rows of the changed keys, a row per key."""
    spark = batch.sparkSession
    if manifest(spark, path, epoch) is not None:
        batch.write.format("noop").mode("overwrite").save()  # the stream's state still has to take the rows in
        return
    last = manifest(spark, path)
    folders = last["folders"] if last else []
    new = f"{epoch:012d}-{uuid.uuid4().hex[:12]}"
    rows = batch
    if len(folders) + 1 >= compact:
        rows = _merged([*_parts(spark, path, folders, batch.schema), batch.withColumn("_at", F.lit(len(folders)))], keys).select(*batch.columns)
        folders = []
    rows.write.parquet(os.path.join(path, FOLDERS, new))
    said = json.dumps({"epoch": epoch, "folders": [*folders, new]})
    spark.range(1, numPartitions=1).select(F.lit(said).alias("value")).write.mode("overwrite").text(os.path.join(path, MANIFESTS, f"{epoch:012d}"))
