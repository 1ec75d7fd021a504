"""Page templates, the prefix trie and the filter audit: brute force, edge cases, extra columns, empty tables."""

import hashlib
import html
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillstone.llm import audit, trie, webpages

PAGES = "page_id long, url string, html string, host string"  # host, an extra column whose name the operator uses inside


def pages(spark, sources, host="a.example"):
    return spark.createDataFrame([(i, None if host is None else f"https://{host}/{i}?q", s, "x") for i, s in enumerate(sources)], PAGES)


def texts(df):
    return {r.page_id: r.text for r in webpages.extract(df).collect()}


SEMANTIC = """<!DOCTYPE html><html class="has-sidebar"><head><title>Not &lt;this&gt;</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Menu %d</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>gone</p> --><script>var t = "</p><article>";</script>
<article><h1>Title %d &amp; more</h1><p>First <b>bold</b>ness<p>Second&nbsp;line<br>goes   on &#233;<div class="ad-box">Buy %d</div><form><label>Name</label><input></form>
<ul><li>one<li>two</ul><table><tr><td>x<td>y</table><aside>Aside</aside><section id="comments"><article class="comment"><p>Nice %d</p></article></section></article>
<div id="sidebar"><p>Side</p></div><footer>&copy; all</footer>"""
WANT = ["Title {0} & more", "First boldness", "Second line goes on é", "one", "two", "x", "y"]


def test_articles_leave_out_what_is_not_theirs(spark):
    got = texts(pages(spark, [SEMANTIC % (i, i, i, i) for i in range(5)]))
    assert got == {i: "\n\n".join(WANT).format(i) for i in range(5)}
    row = webpages.extract(pages(spark, [SEMANTIC % (7, 7, 7, 7)])).first()  # a page alone
    assert (row.page_id, row.url, row.text, row.n_chars) == (0, "https://a.example/0?q", "\n\n".join(WANT).format(7), len(row.text))


def plain_page(rng, i, blocks, attributes='class="entry"'):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    body = [" ".join(word() for _ in range(12)) for _ in range(blocks)]
    source = f"<html><body><div id=top><span>Site name</span></div><div class=links>{'<p>' + word() + '</p>'}</div><div {attributes}><h2>{word()}</h2>"
    head = re.search("<h2>(.*)</h2>", source)[1]
    return source + "".join(f"<p>{b}</p>" for b in body) + "<p>Read our terms before you write to us.</p></div><div class=end>End</div></body></html>", "\n\n".join([head, *body])


def test_the_template_finds_the_main_element_and_its_own_text(spark):
    rng = random.Random(1)
    made = [plain_page(rng, i, 3 + i % 4) for i in range(12)]
    assert texts(pages(spark, [p for p, _ in made])) == {i: t for i, (_, t) in enumerate(made)}
    # With fewer different pages than MANY the recurring line may be the article's own.
    few = [plain_page(rng, i, 3) for i in range(5)]
    assert texts(pages(spark, [p for p, _ in few] * 3)) == {i: few[i % 5][1] + "\n\nRead our terms before you write to us." for i in range(15)}


def test_near_copies_are_no_template(spark):
    shared = "".join(f"<p>Shared sentence {k} of all these pages.</p>" for k in range(20))
    got = texts(pages(spark, [f"<html><body><nav>Menu</nav><article><h1>Title {i}</h1>{shared}</article></body></html>" for i in range(12)]))
    for i, t in got.items():
        assert t.split("\n\n") == [f"Title {i}", *[f"Shared sentence {k} of all these pages." for k in range(20)]]


def test_hosts_with_few_pages_use_the_template_of_all(spark):
    rng = random.Random(2)
    made = [plain_page(rng, i, 4) for i in range(20)]
    rows = [(i, f"http://host{i}.example/", p, "x") for i, (p, _) in enumerate(made)]
    assert texts(spark.createDataFrame(rows, PAGES)) == {i: t + "\n\nRead our terms before you write to us." for i, (_, t) in enumerate(made)}


def test_odd_pages(spark):
    odd = [None, "", "   ", "no tags & all", "<p>a<p>b", "a < b <", "<p>x</p" + "<div>" * 3000 + "deep", "<article>" + "<p>long text</p>" * 20000, "<b><i>open", "</p></div>stray", '<p title="a > b">q</p>', "<script>never ends", "<p>&am &amp &#65; &lt;b&gt;"]
    want = ["", "", "", "no tags & all", "a\n\nb", "a < b <", "x\n\ndeep", "\n\n".join(["long text"] * 20000), "open", "stray", "q", "", "&am & A <b>"]
    for host in ("a.example", None):
        for source, expected in zip(odd, want, strict=True):
            page = webpages._Reader().read(source)
            assert webpages.main_text(page, [], set()) == expected
    both = spark.createDataFrame([(1, None, "<p>a</p>", "x"), (1, "nothing", "<p>a</p>", "x"), (None, "http://h/", None, "x")], PAGES)
    assert Counter((r.page_id, r.text) for r in webpages.extract(both).collect()) == {(1, "a"): 2, (None, ""): 1}
    assert webpages.extract(pages(spark, [])).count() == 0


def test_layouts_are_ordered_and_nested():
    a, b, c, d, e, f = range(6)
    assert webpages.layouts([a, d, e, f, b, d, e, f, c], [[a, b, c], [d, e, f]]) == [([a, b, c], -1, -1), None]  # in two gaps
    assert webpages.layouts([a, d, e, f, d, e, f, b, c], [[a, b, c], [d, e, f]]) == [([a, b, c], -1, -1), ([d, e, f], 0, 0)]
    assert webpages.layouts([a, d, b, e, f, c], [[a, b, c], [d, e, f]])[1] is None  # across a gap
    assert webpages.layouts([a, b, c, a, c, b], [[a, b, c]]) == [None]  # out of order
    assert webpages.layouts([], [[a, b, c]]) == [None]


def brute_article(source):
    blocks = re.split("</?(?:p|h1)>", re.search("(?s)<article>(.*?)</article>", source)[1])
    found = [" ".join(html.unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
    return "\n\n".join(b for b in found if b)


def test_extraction_equals_brute_force_on_the_tables(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: brute_article(r.html) for r in given.collect()}
    assert texts(given) == want


# --- prefix trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, a string"  # a, an extra column whose name the operator uses inside


def brute_trie(rows, family=20, most=4):
    of = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            of[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    of = {c: [t[2:] for t in sorted(ts)] for c, ts in of.items()}
    rebuilt = {}
    for c, own in of.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(abs(c) % family) * (1 if c > 0 else -1)
        rebuilt[c] = tuple(of.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, p in rebuilt.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    words = lambda t: len(re.findall(rb"[^\x20\x09-\x0d]+", t))
    out = []
    for p, ms in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * words(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(ms) if rebuilt[c] == p)
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(spark, rows):
    found = trie.prefix_trie(spark.createDataFrame([(*r, "x") for r in rows], CONVERSATIONS))
    return sorted((tuple(r) for r in found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


@pytest.fixture
def conversations():
    rng = random.Random(5)
    rows = [(c, k, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "é  ü x", "", None])) for c in range(-45, 70) for k in range(rng.randrange(6))]
    rows += [(7, None, "system", "first of all"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (None, 0, "user", "no id")]
    return rows + [(200 + i, k, "user", f"same {k}") for i in range(60) for k in range(3)] + [(500, k, "user", f"turn {k}") for k in range(400)]


def test_trie_equals_brute_force(spark, conversations, monkeypatch):
    want = brute_trie(conversations)
    assert trie_rows(spark, conversations) == want
    # A family's trie in parts, chunks of few ids, parents of many children sent to them.
    monkeypatch.setattr(trie, "NODES", 5)
    monkeypatch.setattr(trie, "CHUNK", 7)
    monkeypatch.setattr(trie, "HOT", 30)
    random.Random(6).shuffle(conversations)
    assert trie_rows(spark, conversations) == want


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie_rows(spark, []) == [] == trie_rows(spark, [(None, 1, "user", "x")])
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert trie_rows(spark, [(c, 0, "user", "gone with the base")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    long = [(1000, 0, "user", "word " * 300_000), (1001, 0, "user", "word " * 300_000)]
    assert trie_rows(spark, long) == brute_trie(long)


# --- filter audit


def brute_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    facts = defaultdict(list)
    for d, t, lang in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        facts[lang or ""].append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out, shapley = [], Counter()
    for part, fs in facts.items():
        for order in itertools.permutations("ABCDE"):
            alive = fs
            for k, f in enumerate(order, 1):
                gone = [x for x in alive if f in x[0]]
                alive = [x for x in alive if f not in x[0]]
                failing = sum(f in x[0] for x in fs)
                out.append((part, "".join(order), k, len(alive), len(gone), failing - len(gone), sum(x[0] == {f} for x in fs), sum(x[1] for x in gone), sum(x[2] for x in gone)))
                shapley[part, f] += len(gone)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_brute_force(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["ab", "Cd", "é", "x#y", "QQQQ", "w1", "zz"]) + str(rng.randrange(rng.choice([3, 1000])))
    body = [" \t\x0b".join(word() for _ in range(rng.randrange(80, 160))) for _ in range(40)]
    rows = [(i, rng.choice([*body, "hot copy", "hot copy", None, "", "A B C"]), rng.choice(["en", "fr", None, ""])) for i in range(400)]
    rows += [(3, rows[3][1], "en"), (3, rows[3][1], "fr"), (None, "hot copy", "en"), (None, None, None), (-1, "word " * 100_000, "de"), (400, "a b " * 300, "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 400, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    given = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, n long")  # n, an extra column
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.audit(audit.flag_counts(given, marks), list("ABCDE"))
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(tuple(r) for r in found.select(*columns).collect()) == brute_audit(rows, labels)
    assert audit.audit(audit.flag_counts(given.where("false"), marks), list("ABCDE")).count() == 0
    one = audit.audit(audit.flag_counts(given.limit(1), marks.where("false")), list("ABCDE"))
    assert one.count() == 600 and one.agg(F.sum("good_lost")).first()[0] == 0


def test_audit_takes_filters_of_its_own(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = audit.flag_counts(docs, labels, {"T": F.col("text") == "a", "N": F.lit(None).cast("boolean")}, copies="Z")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in audit.audit(counts, ["T", "N", "Z"]).collect()}
    assert got["ZTN", 1] == (2, 1, 0) and got["ZTN", 2] == (1, 1, 1) and got["TNZ", 3] == (1, 0, 1) and len(got) == 18
