"""Each operator on hand-made rows: brute force, edge cases, extra columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm import ann, decontam, language, lines, packing, secrets, sharding, simhash, tokens, url_filter, wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, fp string"  # fp, an extra column whose name operators use inside
TEXTS = [None, "", " ", "one", "one two", "É Straße 12 l'été – ok", "a" * 5000, "word " * 9000, "same text here for all of us", "same text here for all of us", "<|endoftext|> it's 'quoted'..."]


def docs(spark, texts=None):
    texts = TEXTS if texts is None else texts
    return spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts)] + [(None, "no id", None, "x")], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- tokens, packing, wavelet matrix


def test_cached_ids_equal_the_tokenizer():
    texts = [*TEXTS, "Don't you'll WE'RE x²½³ ª µ º ÀÉß ÷×", "\x1c\x1d\x85\xa0tab\tnew\nline", "e\u0301 H\u0331 J\u030c", "日本 text İ ΑΣ", "!!!'s ...'ll 'S", "x<|endoftext|>y <|ENDOFTEXT|>", "\u0301a"]
    plain = Tokenizer.from_file(PATH)
    for limit in (3, 1000):
        enc = tokens.Encoder(PATH, limit=limit)
        for _ in range(2):
            ids, cuts = enc.encode(texts)
            for i, t in enumerate(texts):
                assert ids[cuts[i] : cuts[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


def test_rare_strings_do_not_drive_out_frequent_ones():
    encoded = Counter()

    def lengths(new):
        encoded.update(new.to_pylist())
        return np.array([ord(c) for s in new.to_pylist() for c in s], np.uint32), np.array([len(s) for s in new.to_pylist()])

    held, often = tokens._Table(100, lengths), [f"often{i}" for i in range(20)]
    for block in range(200):
        texts = often + [f"rare{block}-{i}" for i in range(30)] + often
        ids, to = held.ids(pa.array(texts))
        assert "".join(map(chr, ids)) == "".join(texts) and np.diff(to).tolist() == [len(s) for s in texts]
        assert len(held.known) <= 100
    assert all(encoded[s] == 1 for s in often)


def test_ids_stay_exact_when_the_cache_lets_go():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "The,", "of", "don't", f"w{rng.randrange(10**6)}x", "É" + "ab" * rng.randrange(9), "日本"]) for _ in range(40)) for _ in range(120)]
    plain, enc = Tokenizer.from_file(PATH), tokens.Encoder(PATH, limit=150)
    for i in range(0, 120, 3):
        ids, cuts = enc.encode(texts[i : i + 3])
        assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts[i : i + 3]]


def test_other_tokenizers_are_used_as_they_are():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.Encoder(path).encode(["Hello  World"])[0].tolist() == Tokenizer.from_file(path).encode("Hello  World", add_special_tokens=False).ids


def encoded(text):
    return np.array(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_packing_places_every_piece_once(spark):
    got = packing.pack_documents(docs(spark), PATH, capacity=64).collect()
    want = Counter()
    for i, t in [*enumerate(TEXTS), (None, "no id")]:
        ids = encoded(t)
        for k, s in enumerate(range(0, len(ids), 64)):
            want[i, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty(spark), PATH, capacity=64).count() == 0


def best_fit_decreasing(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [g for g in bins if g >= length]
        gap = min(fits) if fits else capacity
        if fits:
            bins.remove(gap)
        bins.append(gap - length)
    return len(bins)


def test_sweep_by_ranges_equals_one_sweep():
    rng = random.Random(1)
    for _ in range(200):
        rows = [("doc", v, 0, rng.randint(1, 5), 0, 0, 0) for v in rng.sample(range(1, 60), 20)] + [("gap", v, 10 * v, rng.randint(1, 5), 0, 0, 0) for v in rng.sample(range(1, 64), 12)]
        least = rng.choice((1, 16))
        near = [packing.sweep([r for r in rows if r[1] // 16 == k], 64, least) for k in range(4)]
        assert sorted(packing.sweep([r for x in near for r in x], 64, least)) == sorted(packing.sweep(rows, 64, least))


@pytest.mark.parametrize("capacity,most,n", [(40, 40, 150), (64, 9, 300), (100, 60, 400)])
def test_plan_is_near_best_fit_decreasing(spark, capacity, most, n):
    rng = random.Random(n)
    counts = Counter(rng.randint(1, most) for _ in range(n))
    totals = spark.createDataFrame(list(counts.items()), "length long, n long")
    used, ranks = defaultdict(list), defaultdict(list)
    for r in packing.plan(totals, capacity).collect():
        for k in range(r.n):
            used[r.seq + k // r.each].append((r.at + k % r.each * r.length, r.length))
            ranks[r.length].append(r["first"] + k)
    assert all(sorted(ranks[v]) == list(range(m)) for v, m in counts.items())
    for v in used.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    best = best_fit_decreasing(counts.elements(), capacity)
    assert len(used) <= best + max(1, best // 50)


def test_wavelet_matrix_round_trip_and_support():
    rng = np.random.default_rng(3)
    for n, top in ((0, 8), (1, 8), (700, 5), (3000, 49408)):
        x = rng.integers(0, top, n).astype(np.uint32)
        w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(x, 16).to_bytes())
        assert (w.decode() == x).all()
        for i in rng.integers(0, n, 20) if n else []:
            token, before = int(x[i]), int((x[:i] == x[i]).sum())
            assert w.access(int(i)) == token and w.rank(token, int(i)) == before and w.count(token) == int((x == token).sum()) and w.select(token, before) == i
        assert w.count(60000) == int((x == 60000).sum())


def test_shards_give_back_all_documents(spark):
    shards = wavelet.write_shards(docs(spark), PATH, shard_tokens=50)
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in wavelet.read_documents(shards).collect()))
    start, want = 0, []
    for i, t in [(-1, "no id"), *enumerate(TEXTS)]:
        ids = encoded(t)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    every = np.concatenate([encoded(t) for t in ["no id", *TEXTS]])
    assert sum(r.n for r in wavelet.occurrences(shards, 1).collect()) == int((every == 1).sum())
    assert wavelet.read_documents(wavelet.write_shards(empty(spark), PATH)).count() == 0


# --- line dedup


def test_recurring_lines_stay_once(spark):
    note = "Licensed under the terms of number {} today"
    texts = [f"{w} comes with a line of its own\n" + note.format(i) + f"\nend of {w} text" for i, w in enumerate(("first", "second", "third", "fourth"))]
    got = {r.doc_id: r for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[0].lines_dropped == 0
    for i in (1, 2, 3):
        assert note.format(i) not in got[i].text and texts[i].split("\n")[0] in got[i].text
    assert got[None].text == "no id" and got[1].fp == "x"


def test_variable_words_are_generalised(spark):
    texts = [f"user {n} has logged in from the office of our house now" for n in ("anna", "bert", "cleo", "dora")]
    kept = lines.dedup_lines(docs(spark, texts), depth=1).where("doc_id is not null").collect()
    assert sorted(r.lines_dropped for r in kept) == [0, 1, 1, 1]
    assert all(r.lines_dropped == 0 for r in lines.dedup_lines(docs(spark, texts), depth=4).collect())  # the second token leads to other leaves


def test_lines_edge_cases(spark):
    got = {r.doc_id: r for r in lines.dedup_lines(docs(spark)).collect()}
    for i, t in enumerate(TEXTS):
        if i not in (8, 9):
            assert got[i].text == t
    assert got[8].text == got[9].text == TEXTS[8]  # in two documents only
    assert lines.dedup_lines(empty(spark)).count() == 0
    same = docs(spark, ["a line that is here to be seen again"] * 4)
    out = sorted(r.text for r in lines.dedup_lines(same).where("doc_id is not null").collect())
    assert out == ["", "", "", "a line that is here to be seen again"]


# --- language


def test_languages_are_told_apart(spark):
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["waldo", "thud", "grault"], "cc": ["éàü", "ñandú", "çelik"]}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(words[k], k=30)), k) for i, k in enumerate(list(words) * 30)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(train)
    probe = spark.createDataFrame([(1, "dolor ipsum", "own"), (2, "grault", "own"), (3, "ÇELIK ñandú", "own"), (4, "12 --", "own"), (5, None, "own"), (6, "", "own"), (7, "zzzzzz", "own")], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(probe, model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["aa", "bb", "cc", "und", "und", "und"] and got[7][0] in words
    assert all(0 <= s <= 1 for _, s in got.values()) and got[4][1] == 0
    nothing = language.fit(train.where("false"))
    assert {r.lang_pred for r in language.identify(probe, nothing).collect()} == {"und"}


def test_more_languages_than_bits_of_a_word():
    words = {f"l{i:03d}": f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 3}" for i in range(70)}
    grams = {k: np.concatenate(list(language._keys(language._join([w])[0]))) for k, w in words.items()}
    model = language.Model.build(grams, hashes=3)
    assert model.slots.shape[1] == 2
    langs, _ = model.predict(list(words.values()))
    assert langs == sorted(words)


# --- URL filter

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_urls_are_split_and_judged(spark):
    urls = ["http://WWW.Example.com/en/1", "https://a.example.com/en/", "x://example.com/de", "https://notexample.com/en/x?q=/y", "http://foo.net/es/9#a", "http://net/es/", "nothing", None, "http://a.org", "http://É.ORG\n/p\n?x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, tokens string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, None, RULES).orderBy("page_id").collect()]
    assert got == [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("a.example.com", "/en/", "example.com/en/", "block"), ("example.com", "/de", "com/", "allow"), ("notexample.com", "/en/x", "com/", "allow"),
        ("foo.net", "/es/9", "net/es/", "block"), ("net", "/es/", "net/es/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.org", "", None, "allow"), ("É.org\n", "/p\n", None, "allow"),
    ]
    assert url_filter.filter_urls(pages.where("false"), None, []).count() == 0


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(2)
    urls, bad = [], []
    for i in range(300):
        spam, shop = rng.random() < 0.3, rng.random() < 0.5
        urls.append(f"http://{'spam' if spam else 'good'}.org/{'shop' if shop else 'news'}/{i}")
        bad.append(spam and shop)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, b in enumerate(bad) if i % 2], "key long, bad boolean")
    got = {r.page_id: (r.verdict, r.mined_rule) for r in url_filter.filter_urls(pages, labels, [], 0.02, 0.8).collect()}
    assert {i for i, (v, _) in got.items() if v == "block"} == {i for i, b in enumerate(bad) if b}
    assert {m for v, m in got.values() if v == "block"} == {"h:spam+p:shop"}


# --- secrets

PATTERNS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def brute_spans(text):
    found = [(m.start(), k, m.end(), n) for k, (n, p, g, least) in enumerate(PATTERNS) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(found))


def test_secrets_equal_brute_force_and_ledger_is_incremental(spark):
    texts = [*TEXTS, "é 😀 PassWord = 'abcdef' x token:abc secret: token: abcdefgh", "AKIA" + "A" * 15, "xAKIA" + "B7" * 10 + "AKIA", "f" * 24 + "g" + "0123456789abcdef" * 2, "api_key=" + "a1" * 20, "Kelvin \u212aey to\u212aen=abcdefgh"]
    paths, new, known = secrets.scan(docs(spark, texts), path="doc_id")
    got = {r.path: (r.spans, r.n_assign) for r in secrets.report(paths, known).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == brute_spans(t), t
        assert got[i][1] == brute_spans(t).count("assign:")
    distinct = len({t or "" for t in [*texts, "no id"]})
    assert new.count() == 3 * distinct
    more = docs(spark, [*texts, "token=brandnew1"])
    _, again, all_rows = secrets.scan(more, known, path="doc_id")
    assert again.count() == 3 and all_rows.count() == 3 * (distinct + 1)
    raised = tuple(secrets.Rule(r.name, 2 if r.name == "hex" else 1, r.pattern, r.group, r.least) for r in secrets.BASE_RULES)
    paths2, rescan, all2 = secrets.scan(more, all_rows, raised, path="doc_id")
    assert {r.rule for r in rescan.select("rule").distinct().collect()} == {"hex"} and rescan.count() == distinct + 1
    assert {r.path: r.spans for r in secrets.report(paths2, all2, raised).collect()}[0] == ""
    assert secrets.report(*secrets.scan(empty(spark), path="doc_id")[::2]).count() == 0
    twice = {r.path: (r.spans, r.n_assign) for r in secrets.report(paths, known.unionByName(known)).collect()}
    assert twice == got


def test_a_secret_in_half_of_the_paths_and_a_kept_ledger(spark, tmp_path):
    texts = ["token=abcdef123"] * 60 + [f"text {i}" for i in range(60)]
    at = f"file://{tmp_path}/ledger"
    for part, expected in ((texts[:90], 31 * 3), (texts, 30 * 3)):
        paths, new, known = secrets.scan(docs(spark, part), secrets.open_ledger(spark, at), path="doc_id")
        assert new.count() == expected + (3 if part is not texts else 0)  # and the text of docs() itself
        found = {r.path: r.spans for r in secrets.report(paths, known).collect()}
        assert all(found[i] == brute_spans(t) for i, t in enumerate(part))
        new.write.mode("append").parquet(at)


def test_a_host_of_half_of_the_pages(spark):
    urls = ["http://spam.org/shop"] * 100 + [f"http://good{i % 7}.org/news" for i in range(100)]
    pages = spark.createDataFrame([(i, f"{u}/{i}") for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 100) for i in range(0, 200, 2)], "key long, bad boolean")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, labels, [], 0.02, 0.8).collect()}
    assert all((got[i] == "block") == (i < 100) for i in range(200))


# --- SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_brute_force():
    for t in [*TEXTS, "É\u00a0A\x0bb\x1cc D", "The The THE the " * 5]:
        assert simhash.fingerprint(t) % (1 << 64) == brute_fingerprint(t)


@pytest.mark.parametrize("radius,blocks", [(3, 4), (7, 1)])
def test_components_of_fingerprints_equal_brute_force(spark, radius, blocks):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:20]:
        x = int(b)
        for _ in range(12):
            for bit in rng.integers(0, 64, int(rng.integers(1, 5))):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.near_pairs(df, radius, tile=8, blocks=blocks)).collect()}
    groups = defaultdict(set)
    for f, k in zip(fps.view(np.int64).tolist(), label):
        groups[k].add(f)
    for g in groups.values():
        assert {got.get(f, f) for f in g} == {min(g)}


def test_near_duplicates_edge_cases(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark)).collect()}
    assert got[0].component_id == got[1].component_id == got[2].component_id == 0 and got[0].fingerprint == "0" * 16
    assert got[9].component_id == 8 and got[3].component_id == 3
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_dense_tiles_give_a_forest():
    rng = np.random.default_rng(1)
    a = np.unique(np.bitwise_xor.reduce(np.left_shift(np.uint64(1), rng.integers(0, 64, (500, 2)).astype(np.uint64)), axis=1))
    u, v = simhash.forest(a, a, True, 4)
    assert len(u) == len(a) - 1 and set(v.tolist()) == {int(a[0])}


# --- nearest neighbours


def brute_neighbours(rows, queries, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i, v in queries:
        d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
        for n, j in enumerate([j for j in np.lexsort((ids, d)) if ids[j] != i][:k], 1):
            out[i, n] = (int(ids[j]), float(d[j]))
    return out


def test_neighbours_have_the_recall_asked(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]
    bad = [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, [float("inf")] * 24), (2005, [1.0, 2.0]), (None, rows[5][1])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows + bad], "vec_id long, embedding array<double>, norm int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(ann.build(df, block=64), df.where("vec_id % 20 = 0"), k=10, query_block=8).collect()}
    want = brute_neighbours(rows, [(i, v) for i, v in rows if i % 20 == 0], 10)
    assert got.keys() == want.keys()
    assert np.mean([got[q][0] == want[q][0] for q in want]) >= 0.9
    tied = {q: v for q, v in got.items() if q[0] == 1000}
    assert [tied[1000, n][0] for n in range(1, 11)] == [5, *range(1001, 1010)]


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.search(ann.build(df), df.where("vec_id = 0"), k=10).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 2), (0, 2, 1)]
    none = df.where("false")
    assert ann.build(none) is None and ann.search(None, none).count() == 0


# --- decontamination


def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hit, found = set(), set()
    for i, t in items:
        b = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        n = min(10, len(b))
        windows = {tuple(b[s : s + n]) for s in range(len(b) - n + 1)} if b else set()
        for s in range(len(w) - n + 1):
            if tuple(w[s : s + n]) in windows:
                hit |= set(range(s, s + n))
                found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("ab cd ef gh É é ij 12 x_y".split(" "))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((30, 12, 10, 9, 4, 1, 0, 25))] + [(7, None), (10, "zz " * 40)]
    texts = [*TEXTS, " ".join(word() for _ in range(400)), "before " + items[0][1].upper() + " after", "x. " + items[0][1].replace(" ", ", ")[:60], items[3][1], "zz " * 9, "zz-zz! " * 30]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for short in (True, False):
        use = items if short else [x for x in items if len((x[1] or "").split()) not in (1, 4, 9)]
        got = {r.doc_id: r for r in decontam.decontaminate(docs(spark, texts), bench.where(F.col("item_id").isin([i for i, _ in use])) if not short else bench).collect()}
        for i, t in enumerate(texts):
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute_hits(t, use), (i, short)
            assert r.contaminated == (r.n_hit > 0)
    assert decontam.decontaminate(empty(spark), bench).count() == 0
    assert not any(r.contaminated for r in decontam.decontaminate(docs(spark), bench.where("false")).collect())


# --- recurring lines


def test_many_recurring_lines_of_one_document(spark):
    import time

    lines_of = lambda n: "\n".join(f"line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} of a long log\n" for i in range(n))
    took = {}
    for n in (4000, 16000):
        docs = spark.createDataFrame([(i, lines_of(n)) for i in range(3)], "doc_id long, text string")
        began = time.perf_counter()
        got = {r.doc_id: (r.text, r.lines_dropped) for r in lines.dedup_lines(docs).collect()}
        took[n] = time.perf_counter() - began
        assert got[0] == (lines_of(n), 0)
        for i in (1, 2):
            assert got[i] == ("\n" * (n - 1), n)
    assert took[16000] < 5 * took[4000] + 5  # no square of the lines


# --- sharding


def test_shards_are_even_and_keep_groups(spark):
    texts = [f"text {i}" for i in range(50)] + ["copy one"] * 6 + ["copy two"] * 5 + ["hot"] * 60 + [None, None, ""]
    got = sharding.shard_documents(docs(spark, texts), shards=8, buckets=16).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(texts) + 1 and len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for r in got:
        t = "no id" if r.doc_id is None else texts[r.doc_id]
        raw = (t or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    cut = lambda name: len({r.shard for r in got if r.doc_id is not None and texts[r.doc_id] == name})
    assert cut("copy one") <= 2 and cut("copy two") <= 2 and cut("hot") >= 4
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_full_shards_swap_so_that_copies_meet(spark):
    # Every row has a copy, and the start by hash fills all shards evenly: there is no room at all.
    ids, start = spark.range(3000).select("id", F.pmod(F.pmod(F.xxhash64("id"), F.lit(1024)), F.lit(8)).alias("s")), defaultdict(list)
    for r in ids.collect():
        start[r.s].append(r.id)
    chosen = [i for s in range(8) for i in sorted(start[s])[:150]]
    random.Random(4).shuffle(chosen)
    rows = [(i, f"text {k // 2}") for k, i in enumerate(chosen)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert set(Counter(r.shard for r in got).values()) == {150}
    shard = {r.doc_id: r.shard for r in got}
    assert sum(shard[a] != shard[b] for a, b in zip(chosen[::2], chosen[1::2])) < 60  # of 600; by chance 525
