"""The registered queries: thin wrappers that give each operator its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, language
from .common import table
from .decontam import decontaminate
from .lines import dedup_lines
from .packing import pack_documents
from .secrets import open_ledger, report, scan
from .sharding import shard_documents
from .simhash import near_duplicates
from .trie import prefix_trie
from .url_filter import filter_urls
from .wavelet import read_documents, write_shards
from .webpages import extract

#: Fixed values: (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def tokenizer_path() -> str:
    """The vocabulary file of the public tokenizer; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out() -> Column:
    """The fold that no language model learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def language_model(docs: DataFrame) -> language.Model:
    return language.fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language_model(docs), "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(table(spark, sf_dir, "documents"), tokenizer_path()))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), (F.col("toxic") == 1).alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is kept where the session's setting spark.quillstone.ledger says; without it, it starts empty."""
    at = spark.conf.get("spark.quillstone.ledger", None)
    paths, new, ledger = scan(table(spark, sf_dir, "documents"), open_ledger(spark, at), path="doc_id")
    if at is not None:
        new.write.mode("append").parquet(at)
    found = report(paths, ledger)
    return found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "blob")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(ann.build(vectors), vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op9_winnow_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.flag_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), list("ABCDE"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_wavelet_tokens": op4_wavelet_tokens,
    "op5_url_filter": op5_url_filter,
    "op6_secret_scan": op6_secret_scan,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_one_bit_neighbours": op8_one_bit_neighbours,
    "op9_winnow_decontamination": op9_winnow_decontamination,
    "op10_sharding": op10_sharding,
    "op11_html_extraction": op11_html_extraction,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_filter_audit": op13_filter_audit,
}

def _either(word: str) -> str:
    """A pattern for the word with each letter in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = rf"""({_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

#: DuckDB counterparts of what SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
WITH split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, pos, m, len(string_split(m, ' ')) AS n, array_to_string(string_split(m, ' ')[1:4], ' ') AS lead, len(list_filter(string_split(m, ' '), lambda t: t <> '<*>')) AS words
  FROM (SELECT doc_id, pos, regexp_replace(trim(regexp_replace(line, '[ \t\x0B\f\r]+', ' ', 'g')), '[^ 0-9]*[0-9][^ ]*', '<*>', 'g') AS m FROM split)
  WHERE len(string_split(m, ' ')) >= 3),
mixed AS (SELECT n, lead FROM lines GROUP BY n, lead HAVING min(m) <> max(m) AND min(doc_id) <> max(doc_id)),
forms AS (SELECT m, n, lead, min(doc_id) AS d1, max(doc_id) AS d2, count(*) AS k FROM lines JOIN mixed USING (n, lead) GROUP BY m, n, lead),
leaves AS (SELECT n, lead, sum(k) AS total FROM forms GROUP BY n, lead),
parts AS (SELECT m, n, lead, d1, d2, k, unnest(string_split(m, ' ')) AS token, generate_subscripts(string_split(m, ' '), 1) AS p FROM forms),
constant AS (SELECT n, lead, p, token FROM parts JOIN leaves USING (n, lead) GROUP BY n, lead, p, token HAVING p <= 4 OR (min(d1) <> max(d2) AND 10 * sum(k) >= max(total))),
marked AS (SELECT a.m, a.n, a.p, a.token, c.token IS NOT NULL AS fixed FROM parts a LEFT JOIN constant c ON a.n = c.n AND a.lead = c.lead AND a.p = c.p AND a.token = c.token),
wide AS (
  SELECT m, string_agg(CASE WHEN fixed OR token = '<*>' THEN token ELSE '<*>' END, ' ' ORDER BY p) AS t
  FROM marked GROUP BY m, n
  HAVING count(*) FILTER (fixed OR token = '<*>') >= 0.7 * n AND count(*) FILTER (fixed OR token = '<*>') < n AND count(*) FILTER (fixed AND token <> '<*>') >= 2),
usable AS (SELECT doc_id, pos, n, coalesce(w.t, l.m) AS t FROM lines l LEFT JOIN wide w ON l.m = w.m WHERE words >= 2),
recurring AS (
  SELECT t, min(doc_id) AS first_doc, min({'d': doc_id, 'p': pos}) AS first FROM usable GROUP BY t
  HAVING count(DISTINCT doc_id) >= 3 OR (count(DISTINCT doc_id) >= 2 AND max(n) >= 20)),
gone AS (SELECT doc_id, pos FROM usable u JOIN recurring r ON u.t = r.t WHERE u.doc_id <> r.first.d OR u.pos <> r.first.p),
kept AS (
  SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.pos) FILTER (g.pos IS NULL) AS text, count(*) AS lines_seen, count(g.pos) AS lines_dropped
  FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.pos = g.pos GROUP BY s.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(k.lines_seen, 0) AS BIGINT) AS lines_seen, CAST(coalesce(k.lines_dropped, 0) AS BIGINT) AS lines_dropped
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
    "op6_secret_scan": rf"""
WITH d AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
parted AS (
  SELECT t, 0 AS kind, 'assign' AS name, regexp_extract_all(t, '{_ASSIGN}') AS m, string_split_regex(t, '{_ASSIGN}') AS parts FROM d
  UNION ALL SELECT t, 1, 'access', regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT t, 2, 'hex', regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM d),
matches AS (
  SELECT t, kind, name, m[i] AS hit, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM parted)),
kept AS (
  SELECT t, kind, name, start, start + length(hit) AS stop FROM matches
  WHERE (kind = 0 AND length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 6) OR (kind = 1 AND length(hit) >= 20) OR (kind = 2 AND length(hit) >= 24)),
found AS (
  SELECT t, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM kept GROUP BY t)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(coalesce(text, '')) AS blob
FROM documents LEFT JOIN found ON found.t = coalesce(text, '')
""",
    "op9_winnow_decontamination": r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS run
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS n FROM item_words WHERE len(w) > 0))),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, t.item_id FROM doc_windows d JOIN item_windows t ON d.n = t.n AND d.run = t.run),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
""",
    "op12_prefix_trie": r"""
WITH turns AS (
  SELECT conv_id, r, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
heads AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT h.conv_id, b.i, b.r, b.t FROM heads h JOIN turns b ON b.conv_id = h.base AND b.i <= h.h
  UNION ALL SELECT h.conv_id, o.i, o.r, o.t FROM heads h JOIN turns o ON o.conv_id = h.conv_id AND o.i > h.h),
paths AS (
  SELECT h.conv_id, coalesce(list({'r': r, 't': t} ORDER BY i) FILTER (i IS NOT NULL), []) AS p FROM heads h LEFT JOIN rebuilt x ON h.conv_id = x.conv_id GROUP BY h.conv_id),
prefixes AS (SELECT conv_id, d, p[1 : d] AS pre, len(p) = d AS is_end FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM paths)),
nodes AS (
  SELECT pre, d, min(conv_id) AS c, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '') AS ends,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(list_filter(string_split_regex(pre[d].t, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS saved
  FROM prefixes GROUP BY pre, d),
children AS (SELECT pre[1 : d - 1] AS pre, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN children USING (pre)),
subtrees AS (
  SELECT pre[1 : up] AS pre, sum(saved) AS saved, count(*) FILTER (k = 0) AS leaves FROM (SELECT pre, saved, k, unnest(range(0, d + 1)) AS up FROM whole) GROUP BY ALL)
SELECT w.c AS conv_id, CAST(w.d AS BIGINT) AS depth, p.c AS parent_conv_id, w.n AS n_convs, CAST(w.k AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN subtrees s ON w.pre = s.pre LEFT JOIN whole p ON w.d > 0 AND p.pre = w.pre[1 : w.d - 1]
""",
    "op13_filter_audit": r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM words GROUP BY t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(words.t, '[A-Z]')) > 10 * length(words.t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(words.t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS fails
  FROM words JOIN firsts ON words.t = firsts.t LEFT JOIN marks USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
plan AS (
  SELECT filter_order, step, filter_order[step] AS filter, bits[step] AS bit, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INTEGER) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM flags GROUP BY part, fails),
steps AS (
  SELECT part, filter_order, step, filter, sum(n) FILTER (fails & (before | bit) = 0) AS kept, sum(n) FILTER (fails & before = 0 AND fails & bit <> 0) AS removed,
    sum(n) FILTER (fails & before <> 0 AND fails & bit <> 0) AS redundant, sum(n) FILTER (fails = bit) AS unique_fails,
    sum(g) FILTER (fails & before = 0 AND fails & bit <> 0) AS good_lost, sum(x) FILTER (fails & before = 0 AND fails & bit <> 0) AS toxic_lost
  FROM counted, plan GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley
FROM steps
""",
}
