"""The pipeline's stages against brute force, and the queries against their SQL."""

import re

import duckdb
import pytest
import xxhash

import corpus_pipeline
from quillstone.llm import lines, queries, simhash

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [], spark.read.parquet(f"{DIR}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", None, None, 0), (None, "12 34 --", None, None, 8), (9003, "the and of erthe thon", "en", "s", 21), (9003, "the and of erthe thon", "en", "s", 21)], docs.schema)
    docs = docs.unionByName(odd)
    out.append(("input", docs))
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, DIR).cache()
        out.append((name, docs))
    return dict(out)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_return_the_columns_of_documents(stages):
    for name in ("language_id", "line_dedup", "near_dedup", "decontamination"):
        assert stages[name].columns == stages["input"].columns


def test_language_stage_rejects_documents_without_letters_only(stages):
    want = {r.doc_id for r in stages["input"].collect() if any(map(str.isalpha, r.text or ""))}
    assert {r.doc_id for r in stages["language_id"].collect()} == want


def brute_lines(rows):
    """(doc_id, text) after the line stage, from the definition."""
    blank = re.compile(r"[ \t\x0b\f\r]+")
    found = []
    for doc, (doc_id, text) in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n")):
            m = tuple("<*>" if any(c in "0123456789" for c in t) else t for t in blank.sub(" ", line).strip(" ").split(" "))
            if len(m) >= 3:
                found.append([rows[doc], pos, m])
    leaves = {}
    for doc, pos, m in found:
        leaves.setdefault((len(m), m[:4]), []).append((doc, m))
    template = {}
    for (n, _), own in leaves.items():
        if len({m for _, m in own}) < 2 or len({d for d, _ in own}) < 2:
            continue
        at = {}
        for d, m in own:
            for p, t in enumerate(m):
                at.setdefault((p, t), []).append(d)
        for m in {m for _, m in own}:
            fixed = [p < 4 or t == "<*>" or (len(set(at[p, t])) > 1 and len(at[p, t]) >= 0.1 * len(own)) for p, t in enumerate(m)]
            plain = sum(f and t != "<*>" for f, t in zip(fixed, m))
            if 0.7 * n <= sum(fixed) < n and plain >= 2:
                template[m] = tuple(t if f else "<*>" for f, t in zip(fixed, m))
    uses = {}
    for doc, pos, m in found:
        if sum(t != "<*>" for t in m) >= 2:
            uses.setdefault(template.get(m, m), []).append((doc, pos, len(m)))
    gone = set()
    for own in uses.values():
        docs = {d for d, _, _ in own}
        if len(docs) >= 3 or (len(docs) == 2 and max(n for _, _, n in own) >= 20):
            first = min(((d, p) for d, p, _ in own), key=lambda x: ((x[0][0] is not None, x[0][0] or 0), x[1]))
            gone |= {(d, p) for d, p, _ in own} - {first}
    return [(i, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if ((i, t), p) not in gone)) for i, t in rows]


def test_line_stage_equals_brute_force(stages):
    before, after = ([(r.doc_id, r.text) for r in stages[k].collect()] for k in ("language_id", "line_dedup"))
    want = brute_lines(before)
    assert sorted(after) == sorted(want) and sorted(want) != sorted(before)


def test_hot_templates_and_variable_names(spark):
    # Every name is in two documents of a hundred: a field, not a constant.  A notice is in half of all documents.
    texts = [f"connection closed by remote user n{chr(97 + i // 2 % 25)}{chr(97 + i // 50)} at the outer gateway" for i in range(100)]
    texts += [f"the same notice stands in this text\nbut this line number {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10]} is its own" for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (1, 10_000):
        got = sorted((r.doc_id, r.text) for r in lines.dedup_lines(docs, hot=hot).collect())
        assert got == sorted(brute_lines(list(enumerate(texts))))
    assert sum(t == "" for _, t in got[:100]) == 99 and sum("notice" in t for _, t in got) == 1


ODD = ["row", "doc", "gone", "k1", "k2", "md5", "blob", "first", "probe", "salt", "__doc", "__text", "fp", "copies"]


def test_stages_keep_columns_of_any_name(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in ODD)
    words = "the and of erthe thon with that inge ered"
    rows = [(i, t, "en", "s", 1, *ODD) for i, t in enumerate([words, words, None, "", words + " more"])]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, f in corpus_pipeline.STAGES[:-1]:
            got = f(spark, docs, DIR)
            assert got.columns == docs.columns
            assert all(r[c] == c for r in got.collect() for c in ODD), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == len(data)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_firsts(rows):
    """rows: (doc_id, text); the ids that stay if every pair is compared on its whole sets."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            alike = a == b or len(a & b) ** 2 >= 0.64 * len(a) * len(b) > 0
            if alike and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    first = {}
    for g, (i, _) in zip(group, rows):
        first[g] = min(first.get(g, i), i)
    return sorted(first.values())


def test_near_stage_keeps_one_of_each_group(stages):
    before = [(r.doc_id, r.text) for r in stages["line_dedup"].collect()]
    assert sorted(r.doc_id for r in stages["near_dedup"].collect()) == brute_firsts(before)


def test_contaminated_documents_go(stages, spark):
    from test_operators import brute_hits

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    want = {r.doc_id for r in stages["near_dedup"].collect() if not brute_hits(r.text, items)[1]}
    assert {r.doc_id for r in stages["decontamination"].collect()} == want


def test_packing_holds_what_is_left(stages):
    got = stages["packing"].collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in stages["decontamination"].collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = c.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, DIR)
    assert sorted(found.columns) == sorted(df.columns)
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in df.select(found.columns).collect())


def test_all_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_forests_are_minimal(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for k in range(40):
        base = rng.integers(0, 2**63, 4, np.uint64)
        m = int(rng.integers(2, 14))
        fp = np.stack([base ^ np.array([sum(1 << int(x) for x in rng.choice(64, int(rng.integers(0, 9)), replace=False)) for _ in range(4)], np.uint64) for _ in range(m)])
        n = rng.integers(20, 40, m).astype(np.int32)
        cut = m // 2 if k % 2 else m
        a, b = (np.arange(cut), n[:cut], fp[:cut]), (np.arange(cut, m), n[cut:], fp[cut:]) if cut < m else None
        radius = 20
        links = []
        for i in range(m):
            for j in range(i):
                d = int(np.bitwise_count(fp[i] ^ fp[j]).sum())
                if d <= radius and min(n[i], n[j]) >= 0.64 * max(n[i], n[j]) and (b is None or (i < cut) != (j < cut)):
                    links.append((d, j, i))
        group, weight = list(range(m)), 0
        for d, i, j in sorted(links):
            if group[i] != group[j]:
                weight, group = weight + d, [group[i] if g == group[j] else g for g in group]
        u, v = simhash.wide_forest(a, b, radius, 0.64)
        assert len(u) == m - len(set(group)) and sum(int(np.bitwise_count(fp[i] ^ fp[j]).sum()) for i, j in zip(u, v)) == weight
        assert all((min(i, j), max(i, j)) in {(x, y) for _, x, y in links} for i, j in zip(u.tolist(), v.tolist()))


def test_large_groups_of_near_copies_are_one_group(spark):
    import random

    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(120)]
    texts = [" ".join("changed" + str(i) if k == i % 100 + 6 else w for k, w in enumerate(base)) for i in range(600)]
    texts += [" ".join(rng.sample(base, 120)) for _ in range(20)]  # the same words in other orders
    assert kept_by_near_stage(spark, texts) == [0, *range(600, 620)]


def near_texts():
    """Bases of 60 to 200 words with a chain of copies, and chance pairs of short texts."""
    import random

    rng, texts = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for n in range(60, 200, 4):
        base = [word() for _ in range(n)]
        texts.append(base)
        for _ in range(2):  # changed words far apart cost five shingles each
            base = list(base)
            for at in rng.sample(range(0, n, 6), max(1, n // 50)):
                base[at] = word()
            texts.append(base)
    return [" ".join(t) for t in texts]


def kept_by_near_stage(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, DIR).collect())


def test_near_stage_equals_brute_force_and_finds_copies(spark):
    texts = near_texts()
    got, want = kept_by_near_stage(spark, texts), brute_firsts(list(enumerate(texts)))
    assert set(want) <= set(got) and len(got) - len(want) <= 0.05 * (len(texts) - len(want))  # nothing goes that brute force keeps
    assert sum(i % 3 == 0 for i in got) == len(texts) // 3  # the bases differ and stay
    cosine = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    copies = [i for i in range(len(texts)) if i % 3 and any(cosine(shingle_set(texts[i]), shingle_set(texts[j])) >= 0.8 for j in range(i - i % 3, i))]
    assert sum(i in got for i in copies) <= 0.05 * len(copies)


def test_near_stage_links_no_unlike_texts(spark):
    # Few shingles have near fingerprints by chance if their bits are few.
    few = ["dbbggc jiebhb chijfg hgidgi", "hcebad ajifcj hijdbh jbgahe", "febfbj cedidd iiedha cgceif", "one two three four five six", "one", "two"]
    assert kept_by_near_stage(spark, ["", "a text of its own with some words", *few, "", " "]) == list(range(8))


def test_near_stage_cuts_tiles_without_losing_links(spark):
    from pyspark.sql import functions as F

    sets = simhash.shingle_sets(near_texts())
    rows = [(i, len(s), f.view("int64").tolist(), c.view("int64").tolist()) for i, (s, f, c) in enumerate(zip(sets, simhash.wide_fingerprints(sets), simhash.cells(sets)))]
    rows = [(i, n, f, [*c, 7]) for i, n, f, c in rows]  # one cell that all share
    classes = spark.createDataFrame(rows, "node long, n int, fp array<long>, cells array<long>")
    found = [{(r.node, r.root) for r in simhash.components(simhash.wide_pairs(classes, 0.8, tile=t)).where(F.col("node") != F.col("root")).collect()} for t in (4, 1000)]
    assert found[0] == found[1] and found[0]


def test_near_stage_loses_no_link_at_the_threshold(spark):
    import random

    # A copy of each base of 150 words has five or six changed words, five shingles each: cosines of 0.83 and 0.79.
    rng, texts = random.Random(11), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for k in range(240):
        base = [word() for _ in range(150)]
        other = list(base)
        for at in range(7, 7 + 9 * (5 + k % 3 // 2), 9):
            other[at] = word()
        texts += [" ".join(base), " ".join(other)]
    got = kept_by_near_stage(spark, texts)
    assert got == brute_firsts(list(enumerate(texts))) and 240 < len(got) < 480


@pytest.mark.parametrize("tile", [2, 1024])
def test_rare_pairs_hold_all_links_between_roots(spark, tile):
    from itertools import combinations

    import numpy as np

    texts = [*near_texts(), "one", "two words", "one two three four five six", "one two three four five six seven"]
    sets = simhash.shingle_sets(texts)
    sigs = simhash._signatures(sets)
    rows = [(i, *map(int, sigs[i]), len(s), len(simhash._keys(simhash._low(s))), bytearray(simhash._sketch(s)), i // 2) for i, s in enumerate(sets)]  # every other pair has one root
    classes = spark.createDataFrame(rows, "node long, s1 long, s2 long, n int, low int, bits binary, root long")
    found = simhash.rare_pairs(spark.createDataFrame([(t,) for t in texts], "text string"), classes, 0.8, 5, tile).collect()
    pairs = {(r.u, r.v) for r in found}
    links = {(i, j) for i, j in combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) ** 2 >= 0.64 * len(sets[i]) * len(sets[j])}
    links = {p for p in links if p[0] // 2 != p[1] // 2}
    assert links and links <= pairs and len(pairs) == len(found) and not any(i // 2 == j // 2 for i, j in pairs)


def test_texts_go_to_the_workers_once_and_in_short_batches(spark):
    import pyarrow as pa

    from quillstone.llm import language

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        docs = spark.range(2500, numPartitions=1).selectExpr("id AS doc_id", "concat('the text ', id) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
        for name, f in corpus_pipeline.STAGES:
            if name in ("language_id", "near_dedup", "packing"):
                spark.conf.set(key, "10000")
                f(spark, docs, DIR)
                rows = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
                assert max(r.n for r in rows) <= 1000 and sum(r.n for r in rows) == 2500, name
        found = language.identify(docs, language.Model.build({}))
        assert found.columns == [*docs.columns, "lang_pred", "score"]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "probe" not in plan
    finally:
        spark.conf.set(key, before)


def test_shuffles_that_are_done_go(spark):
    import time
    from pathlib import Path

    from quillstone.llm.common import collect_garbage, materialize

    top = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    before = {p.name for p in top.rglob("shuffle_*.data")}
    materialize(spark.range(100_000).selectExpr("id", "id % 7 AS k").repartition(3, "k"), "shuffled")
    made = {p.name for p in top.rglob("shuffle_*.data")} - before
    assert made
    for _ in range(20):
        collect_garbage(spark)
        time.sleep(0.2)
        if not made & {p.name for p in top.rglob("shuffle_*.data")}:
            return
    raise AssertionError("shuffle files stay")
