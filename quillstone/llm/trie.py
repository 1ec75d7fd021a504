"""Prefix trie of conversations that share their beginnings, merged family first.

Conversations of a family (those with the same base id) often begin with turns of their base.  Each
conversation is rebuilt from the base's first turns and its own later ones; a node of the trie
is a distinct sequence of first turns, its members are the conversations that start with it.

1. *Families.*  Conversations are cogrouped by base id: one shuffle, sorted so that the base comes first.  A task walks
   them turn by turn, keeps the base's first turns and the family's own small trie, and emits a
   row per family node with its members.  Nodes are named by a 128-bit digest that is chained
   turn by turn, so a node has the same name in every family.
2. *Global merging* shuffles only these combined family nodes: a group per name with partial aggregates.
3. *Subtrees without levels.*  The smallest member of a node owns it.  Deeper nodes have fewer
   members, so what a conversation owns is the end of its own path.  Hence the sum of anything over the subtree of v
   is the sum over v's members of all that they own, less what v's owner owns above v.  Two
   shuffles therefore do for any depth; no pass per level.
4. *Ends* are hashed in the order of their ids from chunks of neighbouring ids, so that no task holds a node's list.

Scale: a task holds a family's trie, at most `NODES` nodes; a longer one is emitted in parts, which
merge like those of other families.  Nodes with many children (the root, common first turns) meet their
children by broadcast: those with a thousandth of all nodes as children, of which there are a thousand at most.

Defined cases: rows without conv_id take no part.  Null turns come first; equal turns are ordered
by role, then text; repeated rows are turns of their own.  Null roles and texts are empty.  A
conversation without turns left is a member of the root only.  A very long text or conversation is read
turn by turn.  An empty table has no nodes, not even a root.  Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrow

WORDS = re.compile("[^\x20\x09-\x0d]+")
NODES = 50_000  # of a family, that a task holds
CHUNK = 20_480  # neighbouring ids whose ends are joined before they are hashed
HOT = 1000  # a node with more than one in so many nodes as children is sent to them
FAMILY = "a long, b long, pa long, pb long, depth long, words long, base long, members array<long>, ends array<long>"
ARROW = pa.schema([*[(n, pa.int64()) for n in ("a", "b", "pa", "pb", "depth", "words", "base")], ("members", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
ROOT = bytes(16)


def heads(conv: int, most: int) -> int:
    """How many turns a conversation takes from its base: less than most."""
    return zlib.crc32(str(conv).encode()) % most


def child(node: bytes, role: str, text: str) -> bytes:
    """The name of the node that this turn leads to."""
    r = role.encode()
    return hashlib.blake2b(b"".join((node, struct.pack("<q", len(r)), r, text.encode())), digest_size=16).digest()


class _Walk:
    """The trie of the family that a task is reading."""

    def __init__(self, most: int):
        self.most, self.base, self.conv, self.nodes = most, None, None, {}

    def flush(self) -> pa.RecordBatch:
        rows = []
        for node, (depth, parent, words, members, ends) in self.nodes.items():
            rows.append((*struct.unpack("<qq", node), *(struct.unpack("<qq", parent) if depth else (None, None)), depth, words, self.base, members, ends))
        self.nodes = {}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)

    def end(self) -> None:
        """The conversation is over: it ends where it stands."""
        if self.conv is not None:
            self.visit(*self.at)[4].append(self.conv)
            self.conv = None

    def visit(self, node: bytes, depth: int, parent: bytes, words: int) -> tuple:
        return self.nodes.setdefault(node, (depth, parent, words, [], []))

    def step(self, role: str, text: str) -> None:
        node, depth = self.at[:2]
        self.at = child(node, role, text), depth + 1, node, len(WORDS.findall(text))
        self.visit(*self.at)[3].append(self.conv)

    def turn(self, base: int, conv: int, role: str, text: str) -> Iterator[pa.RecordBatch]:
        if conv != self.conv or base != self.base:
            self.end()
            if base != self.base or len(self.nodes) >= NODES:
                if self.nodes:
                    yield self.flush()
            if base != self.base:
                self.base, self.first = base, []
            self.conv, self.taken, self.seen, self.at = conv, heads(conv, self.most), 0, (ROOT, 0, ROOT, 0)
            self.visit(*self.at)[3].append(conv)
            if conv != base:
                for t in self.first[: self.taken]:
                    self.step(*t)
        self.seen += 1
        if conv == base and self.seen < self.most:
            self.first.append((role, text))
        if conv == base or self.seen > self.taken:
            if len(self.nodes) >= NODES:
                yield self.flush()
            self.step(role, text)


def family_nodes(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """A row per family and node: its name (a, b), its parent's, depth, words of the last text, members and those that end there."""
    rows = narrow(conversations, conv="conv_id", turn="turn", role="role", text="text").where("conv IS NOT NULL")
    rows = rows.select((F.col("conv") - F.col("conv") % family).alias("base"), "conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.col("turn").asc_nulls_first(), "role", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Walk(most)
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield from state.turn(*row)
        state.end()
        if state.nodes:
            yield state.flush()

    return rows.select("base", "conv", "role", "text").mapInArrow(walk, FAMILY)


def ends_hashed(families: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the nodes where conversations end: SHA-256 of their ids, ascending, comma-joined."""
    ends = families.where(F.size("ends") > 0).select("a", "b", F.explode("ends").alias("conv"))
    chunks = ends.groupBy("a", "b", F.floor(F.col("conv") / CHUNK).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "ends_sha256"]
        key, running = None, None
        for batch in batches:
            rows = []
            for a, b, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (a, b) != key:
                    if key is not None:
                        rows.append((*key, running.hexdigest()))
                    key, running = (a, b), hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, running.hexdigest())], names)

    chunks = chunks.repartition("a", "b").sortWithinPartitions("a", "b", "chunk")
    return chunks.select("a", "b", "ids").mapInArrow(digests, "a long, b long, ends_sha256 string")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id; the few parents of very many are sent to their children."""
    parents = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    large = F.col("n_children") > nodes.count() // HOT
    hot, cold = parents.where(large).drop("n_children"), parents.where(~large).drop("n_children")
    met = nodes.join(F.broadcast(hot), ["pa", "pb"], "left")
    rest = met.where("parent_conv_id IS NULL AND depth > 0").drop("parent_conv_id").join(cold, ["pa", "pb"])
    return met.where("parent_conv_id IS NOT NULL OR depth = 0").unionByName(rest)


def prefix_trie(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """A row per node of the trie.

    conversations: conv_id, turn, role, text.  A conversation c takes the first crc32(c) % most turns
    of conversation c - c % family.  Columns: a, b (the node's name), conv_id (smallest member), depth,
    words (of its last text), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (words that
    members share, over the subtree), ends_sha256.
    """
    families = materialize(family_nodes(conversations, family, most), "families")
    merged = families.groupBy("a", "b").agg(F.min(F.array_min("members")).alias("conv_id"), F.sum(F.size("members")).alias("n_convs"), *[F.max(c).alias(c) for c in ("pa", "pb", "depth", "words")])
    merged = materialize(merged.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "merged")
    children = merged.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = materialize(merged.join(children, ["a", "b"], "left").fillna(0, ["n_children"]), "nodes")
    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    by_base = owned.groupBy((F.col("conv_id") - F.col("conv_id") % family).alias("base")).agg(F.map_from_entries(F.collect_list(F.struct("conv_id", F.struct("saved", "leaf")))).alias("owned"))
    # A family row sums what its members own; members that own nothing have no entry.
    part = families.join(by_base, "base").select("a", "b", F.transform("members", lambda m: F.try_element_at("owned", m)).alias("o"))
    total = lambda field: F.aggregate("o", F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x[field], F.lit(0).cast("long")))
    below = part.select("a", "b", total("saved").alias("saved"), total("leaf").alias("leaf")).groupBy("a", "b").agg(F.sum("saved").alias("all_saved"), F.sum("leaf").alias("n_leaves"))
    above = F.expr("coalesce(sum(saved) OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    rows = _with_parents(nodes).withColumn("above", above).join(below, ["a", "b"]).join(ends_hashed(families), ["a", "b"], "left")
    return rows.select(
        "a", "b", "conv_id", "depth", "words", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("all_saved") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
