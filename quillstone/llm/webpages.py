"""Main text of web pages through a template per host, deduced from equivalence classes of tokens.

Pages of a host come from a template that is filled with data.  A token of a page is an opening
or closing tag or a block of text, each together with its path of open elements, so that equal tags in
different places are different tokens.

1. *Classes.*  Tokens of the same host with the same vector of occurrences (how often on which page) form a class.  A vector
   moves as two sums of hashes of (page, count).  Large classes (`LARGE` tokens) that
   occur on at least half of the host's pages come from the template.
2. *Validity.*  A class is valid if on nine tenths of its pages its tokens keep one order and each of its
   instances lies in one and the same gap of another class, or in none.
   The valid classes, nested by their gaps, are the template.
3. *Slots.*  The gaps of the template's classes hold the data.  Slots inside the article's element hold the main
   text: that is an element named so (article, main), or else the deepest one of the template with
   seven tenths of the host's text.  Text that is in the class of tokens that are once on every page (of hosts with
   `MANY` different pages) is part of the template, unless it outweighs what fills the slots: then the
   pages are copies of one another rather than fillings of a template.
4. *Roles.*  Menus, headers, footers, sidebars, notices, adverts, forms and comments, told by element, role
   or class, are left out inside of slots too.

Hosts with fewer than `FEW` different pages use the template of all pages of the table, which has tags only.  A page that does not fit its host's
template is read by its own article or main element, or in full without what rule 4 leaves out.

Blocks are the texts between tags of block elements; <br> is white space.  Character references are
decoded first, so white space is what it is in Unicode (a no-break space too).

Scale: vectors are summed before they move, by (host, token), so a host with a third of all pages is no hot
key.  A template has at most twice as many tokens as a page of its host has on average.  Hosts with
more than one in `HOT` pages (there are fewer than `HOT` of them) get their templates by broadcast; their pages
stay where they are.  The pages of others meet their templates by host.

Defined cases: a null or empty html gives an empty text, like one without any text.  A null url, or one without
"://", has the empty host, which is a host like others.  Repeated pages and ids give a row each; copies of a
page do not make a template by themselves, since FEW and MANY count different pages.  Text and tags without end are
closed at the end of the page.  A very long page is one row's list of tokens.  An empty table gives no rows.
Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrow
from .url_filter import host

LARGE, FEW, MANY, HOT = 3, 3, 8, 1024
SHARE, MASS = 0.9, 0.7  # of pages that keep a class's layout; of the text that the main element holds
ALL = "//"  # the group of all pages; no host has this name

#: Elements by what the standard says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav noscript ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul".split()
)
CLOSED_BY = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr", {"table"}), "td": ("td th", {"tr"}), "th": ("td th", {"tr"}), "option": ("option", {"select"})}
#: Elements, roles and words of class or id that are not part of the article.
LEFT_OUT = frozenset("head script style noscript template nav footer aside form button select option textarea fieldset iframe noembed noframes object svg canvas audio video dialog menu".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination paywall popup promo promoted promotion related replies reply respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
COMMENTS = frozenset("ad ads advert comment comments promo related replies reply sponsored".split())  # what an article can be by its class
SAYS_NO = frozenset("has no non with without".split())  # a word after one of these says nothing of the element itself

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)>?", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
DIGITS = re.compile("[0-9]+")


class Element(NamedTuple):
    name: str
    token: int
    block: bool
    out: bool
    article: bool
    main: bool


class Page(NamedTuple):
    """Tokens in order, the characters of each (tags: 0), and of text tokens (place, text, inside an article, inside main)."""

    tokens: list[int]
    chars: list[int]
    texts: list[tuple[int, str, bool, bool]]
    articles: set[int]
    mains: set[int]


def _token(*parts: object) -> int:
    """A 62-bit number; the closing tag of an element is its complement."""
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) >> 2


def _words(value: str) -> list[str]:
    found = [w.lower() for w in PART.findall(value)]
    return [w for before, w in zip(["", *found], found, strict=False) if before not in SAYS_NO]


def element(parent: Element, name: str, attributes: str) -> Element:
    """The element that an opening tag makes inside its parent."""
    said = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    named = _words(f"{said.get('class', '')} {said.get('id', '')}")
    role = said.get("role", "").lower()
    inside = parent.article or parent.main
    out = parent.out or name in LEFT_OUT or role in ROLES or (not inside and (name == "header" or "header" in named and name not in ("html", "body")))
    if name == "article" or name == "main":
        out = out or not COMMENTS.isdisjoint(named)
    elif name not in ("html", "body"):
        out = out or not WORDS.isdisjoint(named)
    article = parent.article or not out and (name == "article" or said.get("itemprop", "").lower() == "articlebody")
    main = parent.main or not out and (name == "main" or role == "main")
    label = DIGITS.sub("#", " ".join([name, *(f"{k}={said[k]}" for k in ("class", "id", "role") if k in said)]))
    block = name in BLOCK
    return Element(name, _token(parent.token, label) if block else parent.token, block, out, article, main)


class _Reader:
    """Reads one page; elements are found again by parent and tag."""

    def __init__(self):
        self.known: dict[tuple, Element] = {}

    def read(self, source: str | None) -> Page:
        self.page, self.buffer = Page([], [], [], set(), set()), []
        self.stack, self.open = [Element("", 0, True, False, False, False)], {}
        at, source = 0, source or ""
        while tag := TAG.search(source, at):
            if tag.start() > at:
                self.buffer.append(source[at : tag.start()])
            at = tag.end()
            if (name := (tag[2] or "").lower()) == "":
                continue
            if tag[1]:
                self.close(name)
            else:
                self.start(name, tag[3])
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}(?![A-Za-z0-9])", re.I).search(source, at)
                    at = end.start() if end else len(source)
        self.buffer.append(source[at:])
        self.pop(1)
        self.flush()
        return self.page

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.buffer.append(" ")
        if name in VOID and name != "hr":
            return
        if name in BLOCK:
            if self.open.get("p"):
                self.close("p")
            if name in CLOSED_BY:
                names, limits = CLOSED_BY[name]
                for n in names.split():
                    if self.open.get(n):
                        self.close(n, limits)
            self.flush()
        if name == "hr":
            return
        key = (self.stack[-1], name, attributes)
        made = self.known.get(key)
        if made is None:
            if len(self.known) > 100_000:
                self.known.clear()
            made = self.known[key] = element(*key)
        self.stack.append(made)
        self.open[name] = self.open.get(name, 0) + 1
        if made.block:
            self.add(made.token)
            if made.out:
                return
            if made.article and not self.stack[-2].article:
                self.page.articles.add(made.token)
            elif made.main and not self.stack[-2].main:
                self.page.mains.add(made.token)

    def close(self, name: str, limits: frozenset | set = frozenset()) -> None:
        """Closes the innermost open element of that name, unless one of the limits lies above it."""
        if not self.open.get(name):
            if name in BLOCK:
                self.flush()
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == name:
                self.pop(i)
                return
            if self.stack[i].name in limits:
                return

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            if self.stack[-1].block:
                self.flush()
            last = self.stack.pop()
            self.open[last.name] -= 1
            if last.block:
                self.add(~last.token)

    def add(self, token: int, chars: int = 0) -> None:
        self.page.tokens.append(token)
        self.page.chars.append(chars)

    def flush(self) -> None:
        if self.buffer:
            top = self.stack[-1]
            if not top.out:
                text = "".join(html.unescape(x) if "&" in x else x for x in self.buffer)
                if text := " ".join(text.split()):
                    self.page.texts.append((len(self.page.tokens), text, top.article, top.main))
                    self.add(_token(top.token, "text", text), len(text))
            self.buffer = []


def layouts(tokens: list[int], classes: list[list[int]]) -> list[tuple[list[int], int, int] | None]:
    """Of each class: its order on the page, the class whose gap it lies in (-1: none), the gap; None if it is absent, out of order or not nested."""
    of = {t: c for c, members in enumerate(classes) for t in members}
    seen: list[list[int]] = [[] for _ in classes]
    for t in tokens:
        if t in of:
            seen[of[t]].append(t)
    found: list = [None] * len(classes)
    for c, ts in enumerate(seen):
        m = len(classes[c])
        if ts and len(ts) % m == 0 and ts == ts[:m] * (len(ts) // m) and len(set(ts[:m])) == m:
            found[c] = (ts[:m], None, None)
    step, nest = {}, []
    for t in tokens:
        c = of.get(t, -1)
        if c < 0 or not found[c]:
            continue
        j = step.get(c, -1) + 1
        if j == 0:
            parent = (nest[-1], step[nest[-1]]) if nest else (-1, -1)
            if found[c][1] is not None and found[c][1:] != parent:
                found[c] = None  # its instances lie in different gaps
                continue
            found[c] = (found[c][0], *parent)
            nest.append(c)
        else:
            while nest and nest[-1] != c:  # what is still open here does not lie in one gap
                found[nest.pop()] = None
            if not nest:
                found[c] = None
                continue
        step[c] = j
        if j == len(classes[c]) - 1:
            nest.pop()
            step[c] = -1
    return [f if f and f[1] is not None else None for f in found]


def slots(tokens: list[int], template: list[tuple[list[int], int, int]], mains: set[int]) -> list[bool] | None:
    """For each place of the page whether it is in a main slot; None if no class with a main element fits the page."""
    found = layouts(tokens, [t[0] for t in template])
    fits = [f is not None and f[0] == order and (parent < 0 or f[1:] == (parent, gap)) for f, (order, parent, gap) in zip(found, template, strict=True)]
    inside: dict[tuple[int, int], bool] = {}

    def is_main(c: int, j: int) -> bool:
        if c < 0:
            return False
        if (c, j) not in inside:
            order, parent, gap = found[c]
            passed = set(order[: j + 1])
            inside[c, j] = any(t in mains and ~t not in passed for t in passed) or is_main(parent, gap)
        return inside[c, j]

    if not any(fit and not mains.isdisjoint(order) for fit, (order, _, _) in zip(fits, template, strict=True)):
        return None
    of = {t: (c, j) for c, (order, _, _) in enumerate(template) if fits[c] for j, t in enumerate(order)}
    nest, marks = [], []
    for t in tokens:
        if t in of:
            c, j = of[t]
            if j == 0:
                nest.append(None)
            nest[-1] = (c, j)
            if j == len(template[c][0]) - 1:
                nest.pop()
        marks.append(bool(nest) and is_main(*nest[-1]))
    return marks


def main_text(page: Page, template: list[tuple[list[int], int, int]], mains: set[int]) -> str:
    """The text of the page's main slots, its blocks joined by empty lines."""
    marks = slots(page.tokens, template, mains) if template else None
    if marks is None:
        kept = next((k for k in ([x for x in page.texts if x[2]], [x for x in page.texts if x[3]]) if k), page.texts)
        return "\n\n".join(x[1] for x in kept)
    fixed = {t for order, _, _ in template for t in order}
    kept = [x for x in page.texts if marks[x[0]] or page.tokens[x[0]] in fixed and marks[x[0] - 1]]
    data = [x for x in kept if page.tokens[x[0]] not in fixed]
    if 2 * sum(len(x[1]) for x in data) >= sum(len(x[1]) for x in kept):
        kept = data
    return "\n\n".join(x[1] for x in kept)


TOKENS = "host string, content long, tokens array<long>, chars array<int>, names array<long>, counts array<long>, kinds array<int>"
KIND = {"text": 0, "tag": 1, "main": 2, "article": 3}


def _tokens(pages: DataFrame) -> DataFrame:
    """A row per page: its tokens in order, and each different one with its count and kind (closing tags are tags)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            of, content, source = [c.to_pylist() for c in batch.columns]
            out: list[list] = [[], [], [], [], []]
            for x in source:
                page = reader.read(x)
                counts: dict[int, int] = {}
                for t in page.tokens:
                    counts[t] = counts.get(t, 0) + 1
                texts = {page.tokens[i] for i, *_ in page.texts}
                kinds = [KIND["text"] if t in texts else KIND["article"] if t in page.articles else KIND["main"] if t in page.mains else KIND["tag"] for t in counts]
                for column, value in zip(out, (page.tokens, page.chars, list(counts), list(counts.values()), kinds), strict=True):
                    column.append(value)
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(content, pa.int64()), *[pa.array(c, t) for c, t in zip(out, (longs, ints, longs, longs, ints), strict=True)]], ["host", "content", "tokens", "chars", "names", "counts", "kinds"])

    return pages.select("host", F.xxhash64("html").alias("content"), "html").mapInArrow(read, TOKENS)


def _classes(tokens: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, classes array<array<long>>, mains array<long>): large classes of tokens with equal vectors, by host, and their article or main elements."""
    each = tokens.select("host", "content", F.explode(F.arrays_zip("names", "counts", "kinds")).alias("t")).select("host", "content", "t.*")
    each = each.withColumn("h", F.xxhash64("content", "counts"))
    sums = [F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned("h", 32)).alias("high"), F.count("*").alias("support"), F.sum("counts").alias("times"), F.max("kinds").alias("kind")]
    own = each.groupBy("host", "names").agg(*sums).where("support > 1")
    every = each.where("kinds > 0").groupBy("names").agg(*sums).where("support > 1").withColumn("host", F.lit(ALL))
    known = own.unionByName(every).join(hosts, "host").where(f"2 * support >= n AND different >= {FEW}")
    # Text is part of a template only where it is once on every page of many.
    known = known.where(f"kind > 0 OR (support = n AND times = n AND different >= {MANY})")
    classes = known.groupBy("host", "low", "high", "support").agg(F.sort_array(F.collect_list(F.struct("names", "kind"))).alias("members")).where(F.size("members") >= LARGE)
    best = F.aggregate("members", F.lit(0), lambda a, m: F.greatest(a, m["kind"]))
    found = classes.groupBy("host").agg(F.sort_array(F.collect_list("members.names")).alias("classes"), F.flatten(F.collect_list("members")).alias("all"), F.max(best).alias("best"))
    return found.select("host", "classes", F.expr(f"transform(filter(all, m -> m.kind = best AND best > {KIND['tag']}), m -> m.names)").alias("mains"))


def _meet(rows: DataFrame, hosts: DataFrame, per_host: DataFrame, pages: int) -> DataFrame:
    """Left join on host; the hosts of many pages, few by construction, are sent to them."""
    hot = hosts.where((F.col("n") > pages // HOT) & (F.col("host") != ALL)).select("host").join(per_host, "host", "left").withColumn("is hot", F.lit(True))
    met = rows.join(F.broadcast(hot), "host", "left")
    rest = met.where("`is hot` IS NULL").select(*rows.columns).join(per_host, "host", "left")
    return met.where("`is hot`").drop("is hot").unionByName(rest)


LAYOUT = "host string, class int, layout array<long>, parent int, gap int, token long, chars long"


def _layouts(met: DataFrame, of_all: tuple | None) -> DataFrame:
    """A row per page and class there, without a layout if it is out of order or not nested; a row per page and opening tag with the text inside, for hosts without article and main."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["host", "class", "layout", "parent", "gap", "token", "chars"], [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for of, tokens, chars, classes, mains in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for key, cs, ms in ((of, classes, mains), (ALL, *(of_all or (None, None)))):
                    if not cs:
                        continue
                    there = set(tokens)
                    rows += [(key, c, *(f or (None, None, None)), None, None) for c, f in enumerate(layouts(tokens, cs)) if f or not there.isdisjoint(cs[c])]
                    if not ms:
                        members = {t for c in cs for t in c}
                        since, total = {}, 0
                        for t, n in zip(tokens, chars, strict=True):
                            total += n
                            if t in members and t >= 0 and not n:
                                since[t] = total
                            elif ~t in since:
                                rows.append((key, None, None, None, None, ~t, total - since.pop(~t)))
                        rows.append((key, None, None, None, None, None, total))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names)

    return met.select("host", "tokens", "chars", "classes", "mains").mapInArrow(find, LAYOUT)


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(host, template array<struct(layout, parent, gap)>, mains) of every host that has one; (host, n, different); the number of pages.

    pages: host, html.  The template of all pages has the host ALL.
    """
    tokens = materialize(_tokens(pages), "tokens")
    contents = tokens.groupBy("host", "content").agg(F.count("*").alias("k"))
    hosts = contents.groupBy("host").agg(F.sum("k").alias("n"), F.count("*").alias("different"))
    total = tokens.count()
    every = contents.groupBy("content").agg(F.sum("k").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.count("*").alias("different")).select(F.lit(ALL).alias("host"), "n", "different")
    hosts = materialize(hosts.unionByName(every), "hosts")
    classes = materialize(_classes(tokens, hosts), "classes")
    first = classes.where(F.col("host") == ALL).first()
    of_all = (first["classes"], first["mains"]) if first else None
    found = materialize(_layouts(_meet(tokens, hosts, classes, total), of_all), "layouts")
    counted = found.where("class IS NOT NULL").groupBy("host", "class", "layout", "parent", "gap").agg(F.count("*").alias("pages"))
    fitting = F.when(F.col("layout").isNotNull(), F.struct("pages", "layout", "parent", "gap"))
    best = counted.groupBy("host", "class").agg(F.max(fitting).alias("best"), F.sum("pages").alias("all"))
    valid = best.where(F.col("best.pages") >= SHARE * F.col("all"))
    of_host = valid.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("class", "best"))).alias("classes"))
    # Parents by their place among the valid classes; a gap in a class that is not valid is none.
    template = F.expr("transform(classes, c -> struct(c.best.layout AS layout, cast(array_position(transform(classes, d -> d.class), c.best.parent) - 1 AS int) AS parent, c.best.gap AS gap))")
    elements = found.where("class IS NULL").groupBy("host", "token").agg(F.sum("chars").alias("chars"))
    whole = elements.where("token IS NULL").select("host", F.col("chars").alias("whole"))
    heavy = elements.where("token IS NOT NULL").join(whole, "host").where(f"chars >= {MASS} * whole").groupBy("host").agg(F.min_by("token", F.struct("chars", "token")).alias("heavy"))
    made = of_host.select("host", template.alias("template")).join(classes.select("host", "mains"), "host").join(heavy, "host", "left")
    return made.select("host", "template", F.when(F.size("mains") > 0, F.col("mains")).otherwise(F.array_compact(F.array("heavy"))).alias("mains")), hosts, total


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; pages: page_id, url, html."""
    rows = narrow(pages, page_id="page_id", url="url", html="html").withColumn("host", host(F.col("url")))
    made, hosts, total = templates(rows.select("host", "html"))
    made = materialize(made, "templates")
    of_all = made.where(F.col("host") == ALL).first()
    plain = lambda t, m: ([(c["layout"], c["parent"], c["gap"]) for c in t], set(m))
    fallback = plain(of_all["template"], of_all["mains"]) if of_all else ([], set())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            source, template, mains = (batch.column(n).to_pylist() for n in ("html", "template", "mains"))
            texts = [main_text(reader.read(x), *(plain(t, m) if t else fallback)) for x, t, m in zip(source, template, mains, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return _meet(rows, hosts, made, total).select("page_id", "url", "html", "template", "mains").mapInArrow(read, schema)
