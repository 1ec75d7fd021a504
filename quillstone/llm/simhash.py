"""SimHash near-duplicates by tiled exact comparison.

Each distinct fingerprint belongs to a cell, the numbers of ones in its blocks (by default
four of 16 bits).  Two fingerprints at distance d or less differ by d or less in the sum of the
cells' differences, so a tile (some fingerprints of one cell) meets only the tiles of
cells within the radius; all other tile pairs are skipped.  Pairs of tiles are compared
with numpy exclusive-or and bit counts, exactly.  A task reports a spanning forest of the
links that it finds, never all pairs, and rounds of star contraction (Spark joins on a
written edge table) turn the forests into components.

Scale: texts never move; fingerprints are grouped before they are compared, so a group of
copies is one fingerprint; large cells are cut into tiles of bounded size.  No
fingerprint, link or component passes through the driver.

Defined cases: a text without words, empty or null, has fingerprint zero, which links
like any other.  Fewer words than a shingle make one shingle.  Repeated rows get the
same component.  A null doc_id counts only where all ids of a component are null.  An
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import collect_garbage, materialize, narrow, release, small
from .tokens import lists_of

SALTS = 4  # shares of the tiles that meet one tile
WORDS = 4  # 64-bit words of a wide fingerprint
CELLS, LEAST = 12, 3  # numbers by which sets meet, and orders of shingles behind each
KEY_BITS, SKETCH = 40, 2048  # bits of a shingle's hash by which rare shingles meet, and of a set

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)  # of a byte


def shingle_hashes(text: str | None, words_per_shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; fewer words make one shingle, none make none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined_ = b" ".join(words)
    n = max(1, len(words) - words_per_shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[words_per_shingle - 1 :].tolist() or [len(joined_)]
    first = [0, *(ends[: n - 1] + 1).tolist()]
    return np.fromiter(map(xxhash.xxh64_intdigest, [joined_[a:b] for a, b in zip(first, last)], repeat(42)), np.uint64, n)


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """The signed 64-bit fingerprint of a whole text."""
    h = shingle_hashes(text, words_per_shingle)
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.uint16)).ravel(), minlength=2048)
    ones = counts.reshape(8, 256) @ _BITS
    return int(np.packbits((2 * ones.ravel() > len(h)), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (signed long) of every row."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), words_per_shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    docs = narrow(docs, doc_id=doc_id, text=text)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _cell(fp: Column, blocks: int) -> Column:
    width = 64 // blocks
    return F.array(*[F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit(-1 if width == 64 else (1 << width) - 1).cast("long"))).cast("int") for i in range(blocks)])


def forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, root) that connect what a and b connect; same: b is a."""
    values = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    parent = list(range(len(values)))
    label = np.arange(len(values))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    rows = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[at : at + rows, None] ^ b) <= radius)
        i, j = i + at, j + shift
        while True:
            keep = label[i] != label[j]
            i, j = i[keep], j[keep]
            if not len(i):
                break
            for p in {*np.unique(i, return_index=True)[1].tolist(), *np.unique(j, return_index=True)[1].tolist()}:
                x, y = find(int(i[p])), find(int(j[p]))
                parent[max(x, y)] = min(x, y)
            label = np.array(parent)
            while (label != label[label]).any():
                label = label[label]
    linked = np.flatnonzero(label != np.arange(len(values)))
    return values[linked], values[label[linked]]


def near_pairs(fps: DataFrame, radius: int = 3, tile: int = 2048, blocks: int = 4) -> DataFrame:
    """Edges (u, v) between distinct fps (column fp) whose components are those of all links within the radius.

    More blocks skip more tile pairs but send a tile to more cells.
    """
    fps = fps.select("fp", _cell(F.col("fp"), blocks).alias("cell"))
    sizes = fps.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("parts"))
    cut = fps.join(small(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    tiles = materialize(cut.groupBy("cell", "part").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")
    # Half of the steps within the radius, so that each pair of cells meets once.
    steps = [s for s in product(range(-radius, radius + 1), repeat=blocks) if sum(map(abs, s)) <= radius and s >= (0,) * blocks]
    step = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in steps]))
    moved = tiles.select(F.col("part").alias("other_part"), F.col("fps").alias("other"), "cell", step.alias("step"))
    moved = moved.select("other_part", "other", (F.aggregate("step", F.lit(0), lambda s, x: s + F.abs(x)) == 0).alias("same_cell"), F.zip_with("cell", "step", lambda c, s: c + s).alias("cell"), F.pmod(F.xxhash64("cell", "other_part"), F.lit(SALTS)).alias("salt"))
    # A meeting has a key of its own cell and tile, and a share of the tiles that come: no cell is one key.
    moved = moved.join(small(sizes), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    salted = tiles.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = salted.join(moved, ["cell", "part", "salt"]).where(~F.col("same_cell") | (F.col("part") <= F.col("other_part")))
    met = met.select("fps", "other", (F.col("same_cell") & (F.col("part") == F.col("other_part"))).alias("same"))

    def compare(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent.setdefault(p, p)
                x = parent[x]
            return x

        def flush():
            pairs = [(x, find(x)) for x in list(parent)]
            pairs = [p for p in pairs if p[0] != p[1]]
            parent.clear()
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            a, b = ([(x.values.to_numpy(zero_copy_only=False)).view(np.uint64) for x in batch.column(i)] for i in (0, 1))
            for x, y, same in zip(a, b, batch.column(2).to_pylist()):
                for u, v in zip(*(z.view(np.int64).tolist() for z in forest(x, y, same, radius))):
                    u, v = find(u), find(v)
                    if u != v:
                        parent[max(u, v)] = min(u, v)
            if len(parent) > 300_000:  # bounds the memory; links stay
                yield from flush()
        yield from flush()

    return met.mapInArrow(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root: the smallest node of its component.  Star contraction in rounds."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    while True:
        # Done when all that is left are stars: nobody has two parents, and no parent has one.
        two, chained = edges.groupBy("u").count().where("count > 1"), edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi")
        if two.isEmpty() and chained.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = materialize(small_.distinct(), "cc-edges")
        release(edges, large)
        edges = new


def near_duplicates(docs: DataFrame, radius: int = 3, words_per_shingle: int = 3, blocks: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (hex) and component_id, the smallest doc_id that links reach."""
    found = materialize(fingerprints(docs, words_per_shingle, doc_id, text), "simhash-docs")
    classes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    roots = components(near_pairs(classes.select("fp"), radius, blocks=blocks))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by wide fingerprints, verified


def shingle_sets(texts: list[str | None], words_per_shingle: int = 5) -> list[np.ndarray]:
    """The different shingle hashes of each text, ascending."""
    return [np.unique(shingle_hashes(t, words_per_shingle)) for t in texts]


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of 64 * WORDS bits (rows of unsigned words) of each set.

    A bit is set if more than half of the shingles have it; a tie takes the bit of the smallest shingle hash.
    """
    flat = np.concatenate([*sets, np.empty(0, np.uint64)])
    bits = np.stack([_mixed(flat + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(1, WORDS + 1)], axis=1).view(np.uint8)
    out, at = np.zeros((len(sets), WORDS), np.uint64), 0
    places = np.arange(0, 256 * 8 * WORDS, 256, dtype=np.uint16)
    for i, n in enumerate(map(len, sets)):
        if n:
            own = bits[at : at + n]
            ones = 2 * (np.bincount((own + places).ravel(), minlength=256 * 8 * WORDS).reshape(-1, 256) @ _BITS).ravel()
            first = np.unpackbits(own[0], bitorder="little").astype(bool)
            out[i] = np.packbits((ones > n) | ((ones == n) & first), bitorder="little").view(np.uint64)
            at += n
    return out


def _mixed(z: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def cells(sets: list[np.ndarray]) -> np.ndarray:
    """CELLS numbers of each set (zeros for an empty one): each stands for the least of LEAST orders of the shingles.

    Two sets have a number in common with a chance of 1 - (1 - J ** LEAST) ** CELLS, J their Jaccard similarity: 0.98 at a
    cosine of 0.8, 0.9999 at a Jaccard similarity of 0.8.
    """
    out, full = np.zeros((len(sets), CELLS), np.uint64), np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(full):
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    turns = (_mixed(np.arange(1, CELLS * LEAST + 1, dtype=np.uint64)) | np.uint64(1)).reshape(CELLS, LEAST)  # small multiples of one number would give orders that are alike
    for c in range(CELLS):
        made = np.full(len(full), c + 1, np.uint64)
        for turn in turns[c]:
            made = _mixed(made ^ np.minimum.reduceat(_shifted(flat * turn), starts))
        out[full, c] = made
    return out


def _shifted(z: np.ndarray) -> np.ndarray:
    """The high half decides an order by a product; the low half breaks its ties."""
    return (z >> np.uint64(32)) | (z << np.uint64(32))


def radius_for(similarity: float) -> int:
    """Bits at which the shingle sets' cosine is estimated as `similarity`, and 1.5 standard errors more, so that few pairs at it are lost."""
    bits = 64 * WORDS
    p = np.arccos(similarity) / np.pi
    return int(bits * p + 1.5 * np.sqrt(bits * p * (1 - p)))


def wide_pairs(classes: DataFrame, similarity: float, tile: int = 2048) -> DataFrame:
    """Most links (u, v), to be verified, so that few groups are left for rare_pairs, which finds all others; classes: node, n (shingles, 1 or more), fp (WORDS longs), cells (CELLS longs).

    Sets with a cell in common meet; a link: the distance of the fingerprints is at most radius_for(similarity), and the smaller
    set has similarity ** 2 of the larger one's shingles or more, without which no cosine reaches it.  A cell of many sets is cut
    into tiles, and pairs of tiles are skipped whose population counts differ by more than the radius.  Of a pair
    of tiles only a minimum spanning forest of its links is kept: the nearest links, that connect what all links connect.
    """
    radius, ratio = radius_for(similarity), similarity**2
    bits = sum((F.bit_count(F.col("fp")[i]) for i in range(WORDS)), F.lit(0))
    keys = materialize(classes.select("node", F.explode(F.array_distinct("cells")).alias("cell")), "near-cells")
    shared = keys.groupBy("cell").agg(F.count("*").alias("k")).where("k > 1").withColumn("parts", F.ceil(F.col("k") / tile))
    cut = keys.join(shared, "cell").select("cell", "node", "parts")
    rows = cut.join(classes.select("node", "n", "fp", bits.alias("ones")), "node")
    rows = rows.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(0))
    tiles = rows.groupBy("cell", "part").agg(F.max("parts").alias("parts"), F.min("ones").alias("low"), F.max("ones").alias("high"), F.collect_list(F.struct("node", "n", "fp")).alias("rows"))
    tiles = materialize(tiles, "near-tiles")
    alone = tiles.where("parts = 1").select("rows", F.lit(None).cast(tiles.schema["rows"].dataType).alias("others"))
    many = tiles.where("parts > 1")
    # A meeting has a key of its own, so that no cell is one key.
    meeting = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    left = many.withColumn("part2", meeting).where("part <= part2").select("cell", "part", "part2", "low", "high", "rows")
    right = many.select("cell", F.col("part").alias("part2"), "parts", F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("rows").alias("others")).withColumn("part", meeting).where("part <= part2").drop("parts")
    met = left.join(right, ["cell", "part", "part2"]).where((F.col("low2") - F.col("high") <= radius) & (F.col("low") - F.col("high2") <= radius))
    met = met.select("rows", F.when(F.col("part") < F.col("part2"), F.col("others")).alias("others"))

    def compare(batches):
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                a = _tile(batch.column(0)[k].values)
                b = _tile(batch.column(1)[k].values) if batch.column(1)[k].is_valid else None
                found.append(wide_forest(a, b, radius, ratio))
            u, v = (np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v), pa.int64()), pa.array(np.maximum(u, v), pa.int64())], ["u", "v"])

    return alone.unionByName(met).mapInArrow(compare, "u long, v long").distinct()


def _tile(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, sizes and words of a tile's rows."""
    node, n, fp = rows.flatten()
    return node.to_numpy(), n.to_numpy(), fp.flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)


def wide_forest(a: tuple, b: tuple | None, radius: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """A minimum spanning forest of the links between a's and b's rows, or inside of a.

    It grows by the nearest row that is not yet in it (Prim's way): a row's distances are computed once, when it
    comes in, so that memory stays at a few numbers per row even if all rows are linked with all.
    """
    nodes, n, fp = (x if b is None else np.concatenate([x, y]) for x, y in zip(a, b or a, strict=True))
    words, side = np.ascontiguousarray(fp.T), np.arange(len(nodes)) >= len(a[0])
    low, high = np.ceil(n * ratio - 1e-9), np.floor(n / ratio + 1e-9)
    free, taken = 1 << 14, 1 << 15
    key, origin = np.full(len(nodes), free, np.uint16), np.zeros(len(nodes), np.int64)
    u, v = [], []
    for _ in range(len(nodes)):
        i = int(key.argmin())
        if key[i] < free:
            u.append(origin[i])
            v.append(i)
        key[i] = taken
        d = np.zeros(len(nodes), np.uint16)
        for w in range(WORDS):
            d += np.bitwise_count(words[w] ^ words[w, i])
        near = (d <= radius) & (d < key) & (key <= free) & (n >= low[i]) & (n <= high[i])
        if b is not None:
            near &= side != side[i]
        at = np.flatnonzero(near)
        key[at], origin[at] = d[at], i
    return nodes[np.array(u, np.int64)], nodes[np.array(v, np.int64)]


def _keys(s: np.ndarray) -> np.ndarray:
    """Numbers of KEY_BITS bits for ascending shingle hashes, ascending and different."""
    return np.unique(s >> np.uint64(64 - KEY_BITS))


def _low(s: np.ndarray) -> np.ndarray:
    """The ascending shingle hashes that are in the lower half of their range."""
    return s[: np.searchsorted(s, np.uint64(1 << 63))]


def _prefix(n, share: float):
    """How many shingles of n, first in any order common to all sets, hold one of any `share` * n or more that are shared (numbers or a column)."""
    return n - (F if isinstance(n, Column) else np).ceil(n * share - 1e-6) + 1


def rare_pairs(texts: DataFrame, classes: DataFrame, similarity: float, words_per_shingle: int, tile: int = 1024) -> DataFrame:
    """Pairs (u, v) of nodes with different roots, among them each that has the similarity; to be verified.

    texts: text, of each class; classes: node, s1, s2 (key of its set), n (shingles), low (different keys in the lower half), bits, root.
    The shingles of all sets have one order: those in the lower half of the hash range come first, the rarest of them foremost, and
    the others follow by hash.  A pair of the similarity shares similarity * n shingles of the smaller set and similarity ** 2 * n
    of the larger one or more, so what comes first in both orders cannot be different throughout.  Only the lower half is counted
    and shuffled (and what a set lacks there), and what one text alone holds meets nobody.  Pairs that share such a shingle are compared
    in tiles by the places of that shingle and by bits of the whole sets; both only drop pairs that cannot have the similarity.  Keys are
    shorter than hashes: two shingles of one key count as one, and places in the order are too low rather than too high.
    """
    ratio = similarity**2

    def run(batches):
        for batch in batches:
            for _, block in lists_of(batch.column(0)):
                sets = shingle_sets(block, words_per_shingle)
                sigs = _signatures(sets)
                keys = [_keys(s[: max(len(_low(s)), int(_prefix(len(s), ratio)))]) if len(s) else s for s in sets]
                each = [len(k) for k in keys]
                flat = np.concatenate([*keys, np.empty(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sigs[:, 0], each)), pa.array(np.repeat(sigs[:, 1], each)), pa.array(flat)], ["s1", "s2", "key"])

    held = texts.select("text").mapInArrow(run, "s1 long, s2 long, key long").withColumn("df", F.count("*").over(Window.partitionBy("key"))).where("df > 1")
    lower = F.col("key") < 1 << (KEY_BITS - 1)
    held = held.groupBy("s1", "s2", "key").agg(F.max(F.when(lower, F.col("df")).otherwise(1 << 62)).alias("df"))  # once for rows that are repeated
    own = Window.partitionBy("node")
    held = held.join(classes.select("s1", "s2", "node", "n", "low", "root"), ["s1", "s2"]).withColumn("lower", F.sum(lower.cast("int")).over(own))
    held = held.withColumn("at", F.col("low") - F.col("lower") + F.row_number().over(own.orderBy("df", "key")) - 1)
    held = held.where(F.col("at") < _prefix(F.col("n"), ratio)).select("key", "root", "node", "n", "at", (F.col("at") < _prefix(F.col("n"), similarity)).alias("leads"))
    held = materialize(held, "near-rare")
    collect_garbage(texts.sparkSession)
    roots = held.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    held = held.join(roots, "key")
    # The nodes of a large group have tiles of their own, and tiles of one root do not meet: copies are not compared with each other.
    key = Window.partitionBy("key")
    held = held.withColumn("k", F.count("*").over(key)).withColumn("own", F.count("*").over(Window.partitionBy("key", "root"))).join(classes.select("node", "bits"), "node")
    part = F.when(F.col("own") > tile, F.xxhash64("root", F.pmod(F.xxhash64("node"), F.ceil(F.col("own") / tile)))).otherwise(F.pmod(F.xxhash64("root"), F.ceil(F.col("k") / tile)))
    tiles = held.groupBy("key", part.alias("part")).agg(F.max("k").alias("k"), F.min("root").alias("least"), F.max("root").alias("most"), F.collect_list(F.struct("node", "n", "at", "leads", "root", "bits")).alias("rows"))
    tiles = materialize(tiles, "near-tiles")
    collect_garbage(texts.sparkSession)
    many = tiles.where(F.col("k") > tile)
    others = many.select("key", *[F.col(c).alias(f"other {c}") for c in ("part", "least", "most", "rows")])
    met = many.join(others, "key").where((F.col("part") < F.col("other part")) & ((F.col("least") < F.col("other most")) | (F.col("other least") < F.col("most"))))
    met = met.select("rows", F.col("other rows").alias("others"))
    alone = tiles.where("least < most").select("rows", F.lit(None).cast(tiles.schema["rows"].dataType).alias("others"))

    def compare(batches):
        for batch in batches:
            found = [np.empty((0, 2), np.int64)]
            for k in range(batch.num_rows):
                a = _rare_tile(batch.column(0)[k].values)
                found.append(rare_links(a, _rare_tile(batch.column(1)[k].values) if batch.column(1)[k].is_valid else None, ratio))
                if sum(map(len, found)) > 300_000:  # bounds the memory
                    found = [np.unique(np.concatenate(found), axis=0)]
                    if len(found[0]) > 150_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.pop().T], ["u", "v"])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate([*found, np.empty((0, 2), np.int64)]), axis=0).T], ["u", "v"])

    return alone.unionByName(met).mapInArrow(compare, "u long, v long").distinct()


def _rare_tile(rows: pa.StructArray) -> tuple[np.ndarray, ...]:
    """Nodes, sizes, places, whether they lead, roots and bits of a tile's rows."""
    *columns, bits = rows.flatten()
    return *[c.to_numpy(zero_copy_only=False) for c in columns], np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def rare_links(a: tuple, b: tuple | None, ratio: float) -> np.ndarray:
    """Pairs (rows: u < v) of nodes with different roots in a and b, or inside of a, that may have the similarity.

    A bit that one set has and the other lacks is a shingle or more that they do not share.
    """
    (nodes, n, at, leads, root, bits), other = a, b or a
    values, counts = np.unique(np.concatenate([root, other[4]]), return_counts=True)
    most = values[counts.argmax()]  # rows of this root meet only those of others
    ones, other_ones = (np.bitwise_count(x[5]).sum(axis=1, dtype=np.int64) for x in (a, other))
    rare, everyone, others = np.flatnonzero(root != most), np.arange(len(other[0])), np.flatnonzero(other[4] != most)
    found = [np.empty((0, 2), np.int64)]
    for left, right in ((rare, everyone), (np.flatnonzero(root == most), others)):
        step = max(1, (1 << 16) // max(1, len(right)))
        for start in range(0, len(left), step):
            i, j = left[start : start + step, None], right
            n1, n2 = n[i].astype(np.int64), other[1][j].astype(np.int64)
            smaller = (n1 < n2) | ((n1 == n2) & (nodes[i] < other[0][j]))
            able = (root[i] != other[4][j]) & np.where(smaller, leads[i], other[3][j]) & (np.minimum(n1 - at[i], n2 - other[2][j]) ** 2 >= ratio * (1 - 1e-9) * n1 * n2)
            if b is None:
                able &= i < j
            x, y = np.nonzero(able)
            i, j = i[x, 0], j[y]
            n1, n2 = n[i].astype(np.int64), other[1][j].astype(np.int64)
            both = np.bitwise_count(bits[i] & other[5][j]).sum(axis=1, dtype=np.int64)
            able = np.minimum(n1 - ones[i], n2 - other_ones[j]) + both
            able = able**2 >= ratio * (1 - 1e-9) * n1 * n2
            u, v = nodes[i[able]], other[0][j[able]]
            found.append(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1))
    return np.concatenate(found)


def _sketch(s: np.ndarray) -> bytes:
    """SKETCH bits, set where a shingle falls."""
    bits = np.zeros(SKETCH, bool)
    bits[s & np.uint64(SKETCH - 1)] = True
    return np.packbits(bits).tobytes()


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Two longs that stand for each set."""
    return np.frombuffer(b"".join(xxhash.xxh128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)


def _longs(rows: np.ndarray) -> pa.Array:
    """A list of longs per row of unsigned words."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, max(1, rows.shape[1])), pa.int32()), pa.array(rows.ravel().view(np.int64)))


def near_copies(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5) -> DataFrame:
    """(k1, k2, copies, first): keys of each different row, how often it is there, and whether it is the first (by doc_id, then keys) of its group.

    docs: k1, k2 (key of the row), doc_id, text.  Groups are the components of links; two texts are linked if the cosine of their
    sets of shingles is `similarity` or more, which is counted on the whole sets of every link that fingerprints propose.  Texts
    without words are a group of their own.
    """

    def run(batches):
        for batch in batches:
            for at, block in lists_of(batch.column(3)):
                sets = shingle_sets(block, words_per_shingle)
                sigs = _signatures(sets)
                part = batch.slice(at, len(block))
                counts = [pa.array(x, pa.int32()) for x in ([len(s) for s in sets], [len(_keys(_low(s))) for s in sets])]
                bits = pa.array(map(_sketch, sets), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sigs[:, 0]), pa.array(sigs[:, 1]), *counts, bits, _longs(wide_fingerprints(sets)), _longs(cells(sets))], ["k1", "k2", "doc_id", "s1", "s2", "n", "low", "bits", "fp", "cells"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("k1", "k2", "doc_id", "text").mapInArrow(run, f"k1 long, k2 long, doc_id {kind}, s1 long, s2 long, n int, low int, bits binary, fp array<long>, cells array<long>")
    found = materialize(found, "near-docs")
    classes = found.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("least"), F.max("n").alias("n"), F.max("low").alias("low"), F.max("bits").alias("bits"), F.max("fp").alias("fp"), F.max("cells").alias("cells"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    pairs = materialize(wide_pairs(classes.where("n > 0"), similarity), "near-pairs")
    links = materialize(verified(pairs, classes, docs, similarity, words_per_shingle), "near-links")
    roots = components(links)
    # The links that fingerprints miss lead from one of these groups to another.
    grouped = materialize(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("node", "s1", "s2", "n", "low", "bits", "least", "root"), "near-groups")
    collect_garbage(docs.sparkSession)
    copies = found.join(grouped.select("s1", "s2", "least"), ["s1", "s2"]).where(F.struct("doc_id", "k1", "k2") != F.col("least")).select("k1", "k2")
    pairs = materialize(rare_pairs(docs.join(small(copies), ["k1", "k2"], "left_anti"), grouped.where("n > 0"), similarity, words_per_shingle), "near-pairs")
    collect_garbage(docs.sparkSession)
    links = materialize(verified(pairs, classes, docs, similarity, words_per_shingle), "near-links")
    roots = components(links.unionByName(grouped.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    rooted = classes.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    # Of each class only its least row can be the first of the group.
    firsts = rooted.join(best, "root").where(F.col("least") == F.col("best")).select(F.col("least.k1").alias("k1"), F.col("least.k2").alias("k2"), F.lit(True).alias("first"))
    rows = found.groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    return rows.join(firsts, ["k1", "k2"], "left").select("k1", "k2", "copies", F.coalesce("first", F.lit(False)).alias("first"))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float, words_per_shingle: int) -> DataFrame:
    """The pairs (u, v) whose sets have the similarity, counted on all of their shingles; only texts of proposed links are read for it."""

    def run(batches):
        for batch in batches:
            for at, block in lists_of(batch.column(1)):
                sets = [s.view(np.int64) for s in shingle_sets(block, words_per_shingle)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.empty(0, np.int64)]), pa.int64()))], ["node", "shingles"])

    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = materialize(classes.join(nodes, "node").select("node", "least.k1", "least.k2"), "near-wanted")
    texts = docs.select("k1", "k2", "text").join(small(wanted), ["k1", "k2"]).select("node", "text")
    sets = materialize(texts.mapInArrow(run, "node long, shingles array<long>"), "near-sets").dropDuplicates(["node"])
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set {x}")) for x in "uv")
    both = F.size(F.array_intersect("set u", "set v")).cast("double")
    return pairs.join(a, "u").join(b, "v").where(both * both >= similarity**2 * F.size("set u") * F.size("set v") * (1 - 1e-12)).select("u", "v")
