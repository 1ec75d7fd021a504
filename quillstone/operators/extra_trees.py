"""Extremely randomised trees, grown level by level: all trees and nodes of a level in two passes over the rows.

A node looks at a few columns, drawn by hash, and at one threshold of each: a random place between the least and the largest
value that its rows have there.  The first pass finds these bounds, the second counts the classes on both sides; the driver holds
the trees only.  Where a row stands in a tree is an expression over its vector, so no assignment is ever stored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut_lineage


def _unit(*parts: object) -> float:
    """A number in [0, 1) from the parts."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 16**13


@dataclass
class Node:
    """An inner node sends x[column] <= threshold to 2 i + 1 and others to 2 i + 2; a leaf has the share of class 1."""

    share: float
    column: int | None = None
    threshold: float = 0.0


Tree = dict[int, Node]


def value(tree: Tree, x: Column, at: int = 0, leaf=lambda i, n: F.lit(float(n.share))) -> Column:
    """What the tree says of the vector: the leaf's share, or what `leaf` makes of its place."""
    node = tree[at]
    if node.column is None:
        return leaf(at, node)
    return F.when(F.get(x, F.lit(node.column)) <= node.threshold, value(tree, x, 2 * at + 1, leaf)).otherwise(value(tree, x, 2 * at + 2, leaf))


def looked_at(seed: int, tree: int, node: int, width: int, most: int) -> list[int]:
    """The columns that a node looks at."""
    return sorted(range(width), key=lambda j: _unit(seed, tree, node, j))[:most]


def fit(rows: DataFrame, width: int, trees: int = 20, depth: int = 6, least: int = 5, most: int | None = None, seed: int = 1) -> list[Tree]:
    """Trees fitted on rows (y, x).  A node of fewer than 2 `least` rows or of one class is a leaf; a split leaves `least` rows on each side."""
    most = most or max(1, round(math.sqrt(width)))
    rows = cut_lineage(rows.where("y IS NOT NULL").select("y", "x"), "tree-rows")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    if not total.n:
        return [{0: Node(0.5)} for _ in range(trees)]
    forest: list[Tree] = [{0: Node(total.pos / total.n)} for _ in range(trees)]
    open_ = {(t, 0): (total.n, total.pos) for t in range(trees)}
    for _ in range(depth):
        open_ = {k: (n, pos) for k, (n, pos) in open_.items() if n >= 2 * least and 0 < pos < n}
        if not open_:
            break
        # A row's open node in every tree, with the columns that this node looks at.
        columns = {k: looked_at(seed, *k, width, most) for k in open_}
        standing = [_standing(forest[t], t, columns) for t in range(trees)]
        cells = rows.select("y", "x", F.explode(F.filter(F.array(*standing), lambda s: s["node"] >= 0)).alias("s"))
        cells = cells.select("y", F.col("s.tree").alias("tree"), F.col("s.node").alias("node"), F.explode("s.columns").alias("j"), "x").withColumn("v", F.get("x", F.col("j"))).drop("x")
        spans = cells.groupBy("tree", "node", "j").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi").collect()  # a few rows per open node
        cuts = {(r.tree, r.node, r.j): r.lo + (r.hi - r.lo) * _unit(seed, "cut", r.tree, r.node, r.j) for r in spans}
        if not cuts:
            break
        held = F.broadcast(rows.sparkSession.createDataFrame([(*k, c) for k, c in cuts.items()], "tree int, node int, j int, cut double"))
        left = F.col("v") <= F.col("cut")
        counted = cells.join(held, ["tree", "node", "j"]).groupBy("tree", "node", "j").agg(F.count_if(left).alias("n"), F.sum(F.when(left, F.col("y")).otherwise(0)).alias("pos")).collect()
        found: dict = {}
        for r in counted:
            n, pos = open_[r.tree, r.node]
            if least <= r.n <= n - least:
                impure = lambda m, p: p * (m - p) / m  # noqa: E731  # half of Gini's impurity, times the rows
                score = impure(r.n, r.pos) + impure(n - r.n, pos - r.pos)
                found.setdefault((r.tree, r.node), []).append((score, r.j, r.n, r.pos))
        following = {}
        for (t, i), (n, pos) in open_.items():
            if (t, i) in found:
                _, j, m, p = min(found[t, i])
                forest[t][i] = Node(pos / n, j, cuts[t, i, j])
                for at, (a, b) in ((2 * i + 1, (m, p)), (2 * i + 2, (n - m, pos - p))):
                    forest[t][at] = Node(b / a)
                    following[t, at] = (a, b)
        open_ = following
    return forest


def _standing(tree: Tree, t: int, columns: dict[tuple[int, int], list[int]]) -> Column:
    """The row's open node in the tree and the node's columns; -1 where the node is closed."""

    def leaf(i: int, _: Node) -> Column:
        here = (t, i) in columns
        return F.struct(F.lit(t).alias("tree"), F.lit(i if here else -1).alias("node"), F.array(*map(F.lit, columns[t, i] if here else [0])).alias("columns"))

    return value(tree, F.col("x"), leaf=leaf)


def score(forest: list[Tree], x: Column) -> Column:
    """The mean share of class 1 over the trees."""
    return sum((value(t, x) for t in forest), F.lit(0.0)) / float(len(forest))
