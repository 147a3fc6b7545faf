"""Fitted MLlib models as tables, and their predictions recomputed from those tables alone.

A forest's nodes and a logistic model's coefficients are what its writer saved; predicting is then a join per
level of the trees, or a dot product.  It is an independent way to the same answer, and a way to ship a
model to a place that has SQL but no MLlib.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def forest_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``(tree, node, feature, threshold, left, right, share)`` of a saved decision tree or forest; ``share`` holds
    a leaf's share of each class.  Splits are on numbers (no categorical features)."""
    data = spark.read.parquet(os.path.join(path, "data"))
    if "nodeData" not in data.columns:  # one tree
        data = data.select(F.lit(0).alias("treeID"), F.struct(*data.columns).alias("nodeData"))
    n = F.col("nodeData")
    total = F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, v: a + v)
    share = F.transform(n["impurityStats"], lambda v: F.when(total == 0, 0.0).otherwise(v / total))
    split = n["split"]
    if data.where(split["numCategories"] > 0).limit(1).count():
        raise ValueError("categorical splits are not supported")
    return data.select(F.col("treeID").alias("tree"), n["id"].alias("node"), split["featureIndex"].alias("feature"),
                       F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), n["leftChild"].alias("left"),
                       n["rightChild"].alias("right"), share.alias("share"))


def forest_predict(rows: DataFrame, nodes: DataFrame, vec: str = "vec", id_col: str = "id") -> DataFrame:
    """``(id, prediction)``: every row goes down every tree, one join with the nodes per level; the class with the largest sum
    of leaf shares wins (ties: the smallest)."""
    nodes = nodes.persist()  # bounded by the number of trees and their depth
    try:
        trees = [r[0] for r in nodes.select("tree").distinct().collect()]
        # a node's depth is at most the number of levels in which some node has children
        levels, front = 0, nodes.where("node = 0")
        while front.where("left >= 0").limit(1).count():
            levels += 1
            child = front.where("left >= 0").select("tree", F.explode(F.array("left", "right")).alias("node"))
            front = nodes.join(child, ["tree", "node"])
        at = rows.select(F.col(id_col).alias("id"), F.col(vec).alias("v"), F.explode(F.array(*map(F.lit, trees))).alias("tree"), F.lit(0).alias("node"))
        known = F.broadcast(nodes)
        for _ in range(levels):
            x = at.join(known, ["tree", "node"])
            to = F.when(F.col("left") < 0, F.col("node")).when(F.get("v", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
            at = x.select("id", "v", "tree", to.alias("node"))
        leaf = at.join(known, ["tree", "node"]).select("id", F.posexplode("share").alias("cls", "s"))
        votes = leaf.groupBy("id", "cls").agg(F.round(F.sum("s"), 9).alias("s"))
        return votes.groupBy("id").agg(F.min_by("cls", F.struct((-F.col("s")).alias("a"), F.col("cls").alias("b"))).alias("prediction"))
    finally:
        nodes.unpersist()


def logistic_margins(model, vec: Column) -> Column:
    """Margins of all classes as an array: coefficients times features plus intercept (binary models have the margin of class 0 at
    zero)."""
    matrix, offset = model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist()

    def margin(row, b):
        return F.aggregate(F.zip_with(vec, F.array(*map(F.lit, row)), lambda x, c: x * c), F.lit(float(b)), lambda a, v: a + v)

    margins = [margin(r, b) for r, b in zip(matrix, offset, strict=True)]
    return F.array(*([F.lit(0.0)] if len(margins) == 1 else []), *margins)


def logistic_predict(model, rows: DataFrame, vec: str = "vec", id_col: str = "id") -> DataFrame:
    """``(id, prediction)`` of a multinomial or binary logistic model (threshold one half)."""
    m = rows.select(F.col(id_col).alias("id"), logistic_margins(model, F.col(vec)).alias("m"))
    return m.select("id", (F.array_position("m", F.array_max("m")) - 1).cast("int").alias("prediction"))
