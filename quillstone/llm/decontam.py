"""Benchmark decontamination by winnowing.

Both sides hash every run of `k` words and keep the smallest hash of each sliding window
of w hashes.  With w = window - k + 1, any `window` words that a document shares with
an item hold one common kept hash, so no shared span of that length is missed.  Kept
hashes are joined; each hit is extended to the windows that kept it, which are then
compared word for word with the items' windows.

Items shorter than the window are one window each.  Winnowing cannot promise those, so
for each short length that the items have, all runs of that length are looked up.

Scale: each document is read once.  Its windows' smallest hashes meet the benchmark's in the
scan's own task, and only the windows that match leave it, as ten words each; no text moves,
however many documents are hit.  What is broadcast follows the benchmark, not the corpus:
8 bytes for each of its kept hashes up to HASHES, a shuffle beyond.

Defined cases: null or empty texts have no words and no hits.  An item without words has no
window.  Repeated documents get equal rows; repeated items count once per item_id.  A very
long text is one row of arrays and is never cut.  Equal hashes (ties) keep all their windows,
which are compared word for word.  An empty benchmark leaves all documents clean, an empty
table of documents gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, narrow, small

HASHES = 2_000_000  # kept hashes of the benchmark (8 bytes each) that are sent to the tasks

#: Words and what parts them.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def _positions(n: Column) -> Column:
    """0 to n - 1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def grams(hashes: str, k: int) -> Column:
    """A hash for each run of k words of the array column of word hashes."""
    return F.transform(_positions(F.size(hashes) - k + 1), lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)]))


def winnow(g: str, w: int) -> Column:
    """The smallest hash of each window of w in the array column."""
    return F.transform(_positions(F.size(g) - w + 1), lambda i: F.least(*[F.get(g, i + j) for j in range(w)]) if w > 1 else F.get(g, i))


def _marks(rows: DataFrame, lengths: list[int], window: int, k: int) -> DataFrame:
    """Adds `marks` to rows with words `w`: for each length the hashes by which its windows are looked up."""
    rows = rows.withColumn("hashes", F.transform("w", lambda t: F.xxhash64(t))).withColumn("g", grams("hashes", k) if window in lengths else F.lit(None))
    each = [winnow("g", window - k + 1) if n == window else grams("hashes", n) for n in lengths]
    return rows.withColumn("marks", F.concat(*each)).drop("hashes", "g")


def _place(pos: Column, size: Column, lengths: list[int]) -> Column:
    """(n, start) of the mark at this position."""
    out, before = F.lit(None).cast("struct<n:int,start:int>"), F.lit(0)
    cases = []
    for n in lengths:
        count = F.greatest(size - n + 1, F.lit(0))
        cases.append((pos < before + count, F.struct(F.lit(n).alias("n"), (pos - before).cast("int").alias("start"))))
        before = before + count
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def _benchmark(items: DataFrame, window: int, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """Items with words, their windows (n, run, item_ids), both written, and the windows' lengths."""
    bench = materialize(narrow(items, item_id=item_id, text=item_text).select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0"), "leak-items")
    spread = bench.select("item_id", "w", F.least(F.size("w"), F.lit(window)).alias("n"))
    windows = spread.select("item_id", "n", F.explode(F.transform(_positions(F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i + 1, F.col("n")), " "))).alias("run"))
    windows = materialize(windows.groupBy("n", "run").agg(F.collect_set("item_id").alias("item_ids")), "leak-windows")
    return bench, windows, sorted((r.n for r in windows.select("n").distinct().collect()), reverse=True)  # at most `window` lengths


def _scan(docs: DataFrame, items: DataFrame, window: int, k: int, doc_id: str, text: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """(base, found): doc_id, blob and n_words of every row, and (doc_id, blob, start, length, item_ids) of every window found."""
    if window < k:
        raise ValueError("a window has k words at least")
    bench, windows, lengths = _benchmark(items, window, item_id, item_text)
    rows = narrow(docs, doc_id=doc_id, text=text).select("doc_id", F.md5("text").alias("blob"), words(F.col("text")).alias("w"))
    if not lengths:
        base = materialize(rows.select("doc_id", "blob", F.size("w").alias("n_words")), "leak-scan")
        none = base.where("false").select("doc_id", "blob", F.lit(0).alias("start"), F.lit(0).alias("length"), F.array().cast(windows.schema["item_ids"].dataType).alias("item_ids"))
        return base, none
    own = []
    for n in lengths:  # an item has windows of one length
        fits = bench.where(F.size("w") >= n) if n == window else bench.where(F.size("w") == n)
        own.append(_marks(fits, [n], window, k).select(F.explode_outer("marks").alias("h")).where("h is not null"))
    kept = own[0]
    for more in own[1:]:
        kept = kept.unionByName(more)
    kept = small(materialize(kept.distinct(), "leak-kept"), HASHES)
    # The first place stands for the document itself.  The outer form infers no filter, which would be pushed
    # below the columns that it needs and repeat them for each element.
    marked = _marks(rows, lengths, window, k).withColumn("marks", F.concat(F.array(F.lit(None).cast("bigint")), "marks"))
    marked = marked.select("doc_id", "blob", "w", F.posexplode_outer("marks").alias("pos", "h"))
    hits = marked.join(kept.withColumn("hit", F.lit(True)), "h", "left").where("pos = 0 or hit")
    size = F.size("w")
    hits = hits.select("doc_id", "blob", size.alias("n_words"), "w", F.when(F.col("pos") > 0, _place(F.col("pos") - 1, size, lengths)).alias("at"))
    run = F.when(F.col("at").isNotNull(), F.array_join(F.slice("w", F.col("at.start") + 1, F.col("at.n")), " "))
    scanned = materialize(hits.select("doc_id", "blob", "n_words", F.col("at.start").alias("start"), F.col("at.n").alias("n"), run.alias("run")), "leak-scan")
    found = scanned.where("start is not null").join(small(windows), ["n", "run"]).select("doc_id", "blob", "start", F.col("n").alias("length"), "item_ids")
    return scanned.where("start is null").select("doc_id", "blob", "n_words"), found


def contaminated_words(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, blob, start, length, item_ids) of every occurrence of an item's window in a document; blob: the text's MD5."""
    return _scan(docs, items, window, k, doc_id, text, item_id, item_text)[1]


def covered(spans: Column) -> Column:
    """Words inside the union of sorted (start, length) spans."""

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        return F.struct(F.greatest(acc["to"], end).alias("to"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["to"], s["start"]))).alias("n"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), step)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids."""
    base, found = _scan(docs, items, window, k, doc_id, text, item_id, item_text)
    per_doc = found.groupBy("doc_id", "blob").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("item_ids", lambda i: i.cast("string")))))).alias("item_ids"),
    )
    per_doc = per_doc.select(F.col("doc_id").alias("d"), F.col("blob").alias("b"), covered(F.col("spans")).cast("long").alias("n_hit"), "item_ids")
    joined = base.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("blob") == F.col("b")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), ids.alias("item_ids"))
