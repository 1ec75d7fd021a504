"""Language identification with language-bitmask n-gram filters.

Each language has the set of byte n-grams that are typical of it.  The sets are Bloom
filters, stored bit-sliced: slot s holds one bit per language, so one lookup per hash
function and a bitwise and give the mask of all languages that contain an n-gram.  A text's
hits are counted per language, and the counts are corrected for the filter's rate of
false positives: (hits - n * rate) / (1 - rate).  The language with the largest
corrected count wins.

Fitting takes at most `max_docs` labelled documents per language (those with the smallest
hash of their id), a documented bound; the filter's size is fixed, so it can be sent to
every worker.

Defined cases: a null text, or one without a letter, is ``und`` with score 0.  Ties go to the
first language in alphabetical order; a text whose n-grams are all unknown is such a tie.
Without any training document everything is ``und``.  A very long text is read whole.  Repeated
rows are predicted each.  An empty table gives an empty result.  Extra columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, narrow, small, unit_hash
from .tokens import in_blocks, lists_of

UNKNOWN = "und"
SIZES = (2, 3, 4)  # bytes of an n-gram
_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
GAP = b" " * max(SIZES)


def _join(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as letters and blanks, and where each starts; no n-gram reaches from one into the next."""
    parts = [b" " + (t or "").lower().encode("utf-8", "replace").translate(_BLANK) + GAP for t in texts]
    starts = np.cumsum([0, *map(len, parts)])
    return np.frombuffer(b"".join(parts), np.uint8), starts


def _keys(data: np.ndarray):
    """The n-grams that start at each byte, as integers that differ between sizes."""
    wide = np.concatenate([data, np.full(max(SIZES), 32, np.uint8)]).astype(np.uint64)
    n, key = len(data), np.zeros(len(data), np.uint64)
    for i in range(max(SIZES)):
        key = key | wide[i : i + n] << np.uint64(8 * i)
        if i + 1 in SIZES:
            yield key | np.uint64((i + 1) << 56)


@dataclass
class Model:
    """slots[s, l // 64]: bit l % 64 is set if language l has an n-gram there; rates: false positives per language."""

    langs: list[str]
    slots: np.ndarray
    rates: np.ndarray
    hashes: int

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], log2_slots: int = 20, hashes: int = 2) -> Model:
        langs = sorted(grams)
        kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(langs) <= np.iinfo(t).bits), np.uint64)
        slots = np.zeros((1 << log2_slots, max(1, -(-len(langs) // 64))), kind)
        for i, lang in enumerate(langs):
            for place in cls._places(grams[lang], log2_slots, hashes):
                slots[place, i // 64] |= kind(1 << i % 64)
        full = np.array([cls._has(slots, i).mean() for i in range(len(langs))])
        return cls(langs, slots, full**hashes, hashes)

    @staticmethod
    def _places(keys: np.ndarray, log2_slots: int, hashes: int):
        for m in _MULTIPLIERS[:hashes]:
            h = keys * np.uint64(m)
            yield (h ^ h >> np.uint64(29)) * np.uint64(_MULTIPLIERS[-1]) >> np.uint64(64 - log2_slots)

    @staticmethod
    def _has(masks: np.ndarray, i: int) -> np.ndarray:
        """Language i's bit of each mask."""
        kind = masks.dtype.type
        return masks[:, i // 64] >> kind(i % 64) & kind(1)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """The bitmask of languages that contain each n-gram."""
        log2_slots, mask = len(self.slots).bit_length() - 1, None
        for place in self._places(keys, log2_slots, self.hashes):
            got = self.slots[place.astype(np.int64)]
            mask = got if mask is None else mask & got
        return mask

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Corrected counts, one row per text and one column per language."""
        data, starts = _join(texts)
        hits = np.zeros((len(texts), len(self.langs)))
        for keys in _keys(data):
            mask = self.masks(keys)
            for i in range(len(self.langs)):
                hits[:, i] += np.add.reduceat(self._has(mask, i).astype(np.int32), starts[:-1])
        n = np.diff(starts)[:, None] * len(SIZES)
        return np.maximum(0, (hits - n * self.rates) / (1 - self.rates))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        scores = self.scores(texts)
        total = scores.sum(1)
        share = np.divide(scores.max(1), total, out=np.zeros(len(texts)), where=total > 0)
        letters = [any(map(str.isalpha, t or "")) for t in texts]
        langs = [self.langs[i] if ok else UNKNOWN for i, ok in zip(scores.argmax(1).tolist(), letters)]
        return langs, np.where(letters, share, 0.0)


def fit(docs: DataFrame, max_docs: int = 2000, least_share: float = 2e-5, relative: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model from labelled documents.

    An n-gram is typical of a language if it makes up least_share of the language's n-grams
    and at least `relative` of its largest share among the languages.  So a language has at most
    1 / least_share n-grams, the bound of what the driver gathers.
    """
    docs = narrow(docs, doc_id=doc_id, text=text, lang=lang).where("lang is not null and text is not null")
    # Ids first: no text is sorted or shuffled for the choice of the sample.  Only hashes that can be among the
    # smallest are put in order, so a language with most of the documents is no task of its own.
    sizes = docs.groupBy("lang").agg(F.count("*").alias("size"))
    likely = docs.select("doc_id", "lang", unit_hash("doc_id").alias("u")).join(small(sizes), "lang").where(F.col("u") * F.col("size") < 1.25 * max_docs + 50)
    order = Window.partitionBy("lang").orderBy("u", "doc_id")
    chosen = likely.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_docs).select("doc_id").distinct()
    sample = docs.join(F.broadcast(chosen), "doc_id", "left_semi")  # at most max_docs ids per language

    def count(batches):
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for lang_here in sorted(set(langs)):
                own = [t for t, l in zip(texts, langs) if l == lang_here]
                for _, block in in_blocks(own):
                    keys = np.concatenate(list(_keys(_join(block)[0])))
                    found, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang_here] * len(found)), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    grams = sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = grams.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= least_share)
    top = F.max("share").over(Window.partitionBy("gram"))
    typical = shares.withColumn("top", top).where(F.col("share") >= relative * F.col("top")).select("lang", "gram").toPandas()
    return Model.build({str(k): g["gram"].to_numpy().view(np.uint64) for k, g in typical.groupby("lang")})


def identify(docs: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """The columns `keep` (all by default) with lang_pred and score; a column of those names is replaced."""
    names = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index(text) if text in names else len(names)
    probe = text if text in names else free(docs, "probe")  # texts that are kept go to the workers once
    source = docs.select(*[F.col(f"`{c}`") for c in names], *([] if probe in names else [F.col(f"`{text}`").alias(probe)]))

    def run(batches):
        for batch in batches:
            langs, scores = [], []
            for _, block in lists_of(batch.column(at)):
                a, b = held.value.predict(block)
                langs += a
                scores.append(b)
            both = [pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *both], [*names, "lang_pred", "score"])

    schema = source.select(*[F.col(f"`{c}`") for c in names]).schema.add("lang_pred", "string").add("score", "double")
    return source.mapInArrow(run, schema)
