"""Boosted trees stage by stage: fitted trees become column expressions, and the score after each stage is a running sum of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import feature_auc


def tree_value(tree, x: Column) -> Column:
    """What a fitted regression tree says of the vector, as nested conditions."""

    def of(node) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(F.get(x, F.lit(int(split.featureIndex()))) <= float(split.threshold()), of(node.leftChild())).otherwise(of(node.rightChild()))

    return of(tree._java_obj.rootNode())


def stage_margins(model, x: Column) -> Column:
    """The margins after each stage of a boosted classifier, as an array; twice the last one is the log odds of class 1."""
    pieces = F.array(*[F.lit(float(w)) * tree_value(t, x) for t, w in zip(model.trees, model.treeWeights, strict=True)])
    grow = lambda acc, v: F.array_append(acc, F.coalesce(F.element_at(acc, -1), F.lit(0.0)) + v)
    return F.aggregate(F.slice(pieces, 2, F.size(pieces)), F.slice(pieces, 1, 1), grow)


def history(model, train: DataFrame, valid: DataFrame) -> DataFrame:
    """(stage, train_auc, valid_auc, gap) of a boosted classifier; train and valid: y, x."""
    both = train.select("y", "x", F.lit("train").alias("part")).unionByName(valid.select("y", "x", F.lit("valid").alias("part")))
    long = both.select("y", "part", F.posexplode(stage_margins(model, F.col("x"))).alias("stage", "v"))
    auc = feature_auc(long, "stage", "part").groupBy("stage").agg(*[F.max(F.when(F.col("part") == p, F.col("auc"))).alias(f"{p}_auc") for p in ("train", "valid")])
    return auc.select((F.col("stage") + 1).alias("stage"), "train_auc", "valid_auc", (F.col("train_auc") - F.col("valid_auc")).alias("gap"))
