"""Token ids of whole texts with a cache of chunks.

The tokenizer does all the encoding.  For tokenizers that split a text into words by the
pattern below, drop white space and mark the end of each word (a ``</w>`` suffix), what
stands between ASCII white space gets the same ids wherever it stands, since no word, no
composed character and no special token reaches across it.  So each worker encodes each
distinct chunk once and looks up the rest, with Arrow's hash tables and without a Python
object for each word.  Other tokenizers encode each text as it is.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pattern for which the cache is exact.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEP = 1 << 15  # strings whose ids are gathered at once
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t\n\x0b\x0c\r \x85\xa0"
_WORD = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


class _Table:
    """Strings that have been encoded, and their ids in a row; `limit` strings bound the memory.

    A full table keeps what was looked up again, the most used first: the words of a text's long
    tail come once and would else drive out the frequent ones, which are then encoded anew.
    """

    def __init__(self, limit: int, encode) -> None:
        self.limit, self.encode = limit, encode
        self.forget()

    def forget(self) -> None:
        self.known, self.flat = pa.array([], pa.string()), np.empty(0, np.uint32)
        self.at, self.length, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def thin(self, most: int) -> None:
        """Keeps at most so many strings, and halves their uses, so that old ones fade."""
        kept = np.flatnonzero(self.used)
        if len(kept) > most:
            kept = np.sort(kept[np.argsort(-self.used[kept], kind="stable")[: max(0, most)]])
        if not len(kept):
            self.forget()
            return
        n = self.length[kept]
        to = np.cumsum(n) - n
        self.flat = self.flat[np.repeat(self.at[kept] - to, n) + np.arange(n.sum())]
        self.known, self.at, self.length, self.used = self.known.take(pa.array(kept)), to, n, self.used[kept] // 2

    def numbers(self, some: pa.Array) -> np.ndarray:
        """The place in the table of each of these distinct strings; new ones are encoded and added."""
        found = pc.index_in(some, value_set=self.known)
        new = some.filter(pc.is_null(found))
        if len(new) and len(self.known) and len(self.known) + len(new) > self.limit:
            self.thin(min(self.limit // 2, self.limit - len(some)))
            return self.numbers(some)
        found = found.fill_null(-1).to_numpy().astype(np.int64)
        self.used[found[found >= 0]] += 1
        if len(new):
            found[found < 0] = len(self.known) + np.arange(len(new))
            ids, length = self.encode(new)
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(length) - length])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
            self.length, self.flat, self.known = np.concatenate([self.length, length]), np.concatenate([self.flat, ids]), pa.concat_arrays([self.known, new])
        return found

    def ids(self, some: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings in a row, and where each starts."""
        each = some.dictionary_encode()
        which = self.numbers(each.dictionary)[each.indices.to_numpy()]
        n = self.length[which]
        to = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        out = np.empty(to[-1], np.uint32)
        for a in range(0, len(n), STEP):  # places are longs: never those of all ids at once
            b = min(a + STEP, len(n))
            out[to[a] : to[b]] = self.flat[np.repeat(self.at[which[a:b]] - to[a:b], n[a:b]) + np.arange(to[a], to[b])]
        return out, to


class Encoder:
    """encode(texts) gives the ids of all texts in a row and where each text starts; None counts as empty.

    limit: chunks, and words, that the caches hold before they let go of rare ones, which bounds the memory.
    """

    def __init__(self, path: str, limit: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        patterns = [s["pattern"].get("Regex") for s in steps if s["type"] == "Split"]
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_chunk = patterns == [SPLIT] and normal == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>" and not spec["model"].get("dropout")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        del spec
        # The model for words that are parted and spelled in its byte letters already.
        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        del vocabulary
        self.model.normalizer, self.model.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {i: spell(chr(i))[0][0] for i in range(256) if i != 32}
        self.chunks, self.words = _Table(limit, self._chunks), _Table(limit, self._words)

    def _plain(self, text: str | None) -> np.ndarray:
        if self.tokenizer is None:  # few texts need it, and it takes its memory
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, np.uint32)

    def _each(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and the number of each text's, by the tokenizer alone."""
        found = [self._plain(t) for t in texts.to_pylist()]
        return np.concatenate([*found, np.empty(0, np.uint32)]), np.array([len(x) for x in found], np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for lower-case Latin-1 words."""
        ids, lengths = [], []
        for i in range(0, len(words), 1000):
            some = words.slice(i, 1000)
            # The fast call leaves out the places of tokens in the text, nothing else.
            found = self.model.encode_batch_fast([" ".join(some.to_pylist()).translate(self.letters)], add_special_tokens=False)
            got = np.array(found[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[got])
            n = np.diff(ends, prepend=-1)
            if len(ends) != len(some) or ends[-1] != len(got) - 1:
                got, n = self._each(some)
            ids.append(got)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for what stands between white space."""
        text = "\n".join(chunks.to_pylist())
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            text = None
        if text is None or any(s in text for s in self.special):  # a few of the chunks, as a rule
            odd = pc.match_substring_regex(chunks, "[^\\x{00}-\\x{ff}]|" + "|".join(map(re.escape, self.special)))
            if pc.all(odd).as_py():
                return self._each(chunks)
            (a, n), (b, m) = self._chunks(chunks.filter(pc.invert(odd))), self._each(chunks.filter(odd))
            place = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
            first = np.concatenate([np.cumsum(n) - n, len(a) + np.cumsum(m) - m])
            at, length = np.empty_like(first), np.empty_like(first)
            at[place], length[place] = first, np.concatenate([n, m])
            to = np.cumsum(length) - length
            return np.concatenate([a, b])[np.repeat(at - to, length) + np.arange(length.sum())], length
        found = pa.array(_WORD.findall(text.lower()), pa.string())
        ends = np.flatnonzero(pc.equal(found, "\n").to_numpy(zero_copy_only=False))
        cuts = np.concatenate([[0], ends - np.arange(len(ends)), [len(found) - len(ends)]]).astype(np.int64)
        ids, to = self.words.ids(found.filter(pc.not_equal(found, "\n")))
        return ids, np.diff(to[cuts])

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not self.by_chunk:
            ids, length = self._each(texts)
            return ids, np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        ids, to = self.chunks.ids(lists.flatten())
        pa.default_memory_pool().release_unused()
        return ids, to[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)]


def with_end(ids: np.ndarray, cuts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each text."""
    out = np.full(len(ids) + len(cuts) - 1, end_id, np.uint32)
    own = np.ones(len(out), bool)
    own[cuts[1:] + np.arange(len(cuts) - 1)] = False
    out[own] = ids
    return out, cuts + np.arange(len(cuts))


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, limit: int = 500_000) -> Encoder:
    """The worker's encoder for the file; a Python worker serves many tasks."""
    if (path, limit) not in _encoders:
        _encoders[path, limit] = Encoder(path, limit)
    return _encoders[path, limit]


def blocks(texts: pa.Array, size: int = 1 << 22):
    """(start, end) of slices with about so many bytes each."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist(), 1):
        held += n
        if held >= size:
            yield start, i
            start, held = i, 0
    if start < len(texts):
        yield start, len(texts)


def in_blocks(texts: list[str | None], chars: int = 1 << 20):
    """Slices of the list with about so many characters each."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= chars:
            yield start, texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def lists_of(texts, rows: int = 256):
    """(start, list) of some rows of an Arrow column at a time, so that a batch is never a list of strings as a whole."""
    for at in range(0, len(texts), rows):
        for start, block in in_blocks(texts.slice(at, rows).to_pylist()):
            yield at + start, block
