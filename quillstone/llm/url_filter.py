"""URL filters by association rules.

FP-growth mines combinations of URL tokens that go with a bad label.  A rule is kept if
its support and confidence reach the bounds and if no shorter rule inside it is as
confident.  Rules match through an inverted index: each is posted under the rarest of
its tokens, pages are joined with the postings, and the rest of the rule is tested on
the pages found.  Given host/path rules come first; the mined rules judge what is left.

Defined cases: a null url, or one without ``://``, has an empty host and path, no
tokens, no rule and the verdict allow.  A very long url is judged whole.  Repeated pages are
judged alike, each in its own row.  Of rules of equal confidence the last by name counts.  An
empty table gives no rows; extra columns are ignored.  Without labelled pages nothing is mined and the default verdict is allow.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, narrow, salted_join

BAD, GOOD = "label=bad", "label=good"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels, words of the path and names of query fields; numbers are left out."""
    labels = F.transform(F.filter(F.split(host(url), r"\."), lambda t: t != ""), lambda t: F.concat(F.lit("h:"), t))
    words = F.transform(F.filter(F.split(path(url), r"[^A-Za-z]+"), lambda t: t != ""), lambda t: F.concat(F.lit("p:"), ascii_lower(t)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    fields = F.transform(F.filter(F.split(query, "&"), lambda t: t != ""), lambda t: F.concat(F.lit("q:"), F.substring_index(t, "=", 1)))
    return F.array_distinct(F.concat(labels, words, fields))


def given_rule(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule of (verdict, host, path) as a struct; null if none fits."""
    kind = "array<struct<n:int,rule:string,host:string,path:string,verdict:string>>"
    if not rules:
        return F.lit(None).cast(kind[6:-1])
    given = F.array(*[F.struct(F.lit(len(rh) + len(rp)).alias("n"), F.lit(rh + rp).alias("rule"), F.lit(rh).alias("host"), F.lit(rp).alias("path"), F.lit(v).alias("verdict")) for v, rh, rp in rules])
    fits = F.filter(given, lambda r: ((h == r.host) | F.endswith(h, F.concat(F.lit("."), r.host))) & F.startswith(p, r.path))
    return F.array_max(fits)


def mine_rules(items: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """rule_id, antecedent, confidence, support and posting token from labelled token lists (items, bad)."""
    labelled = items.select(F.array_append("tokens", F.when(F.col("bad"), BAD).otherwise(GOOD)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(labelled)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    found = materialize(found.withColumn("rule_id", F.concat_ws("+", "antecedent")), "url-rules")
    # Pruned: a rule that contains a shorter one of at least its confidence.
    parts = found.select("rule_id", "confidence", "antecedent", F.explode("antecedent").alias("token"))
    shorter = found.select(F.col("rule_id").alias("short_id"), F.col("antecedent").alias("short"), F.col("confidence").alias("short_confidence"), F.explode("antecedent").alias("token"))
    covered = parts.join(shorter, "token").where((F.col("short_id") != F.col("rule_id")) & (F.size("short") < F.size("antecedent")) & (F.col("short_confidence") >= F.col("confidence")) & (F.size(F.array_except("short", "antecedent")) == 0))
    found = found.join(covered.select("rule_id").distinct(), "rule_id", "left_anti")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    posting = found.select("rule_id", F.explode("antecedent").alias("token")).join(single, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("freq", "token")).alias("posting"))
    return found.join(posting, "rule_id")


def filter_urls(pages: DataFrame, labels: DataFrame | None, rules: list[tuple[str, str, str]], min_support: float = 0.002, min_confidence: float = 0.5, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule and confidence of every page.

    labels: (key, bad boolean); the key of a page is the first number among the segments of
    its path, the document that the page shows.  rules: (verdict, host, path).
    """
    pages = narrow(pages, page_id=page_id, url=url).withColumn("tokens", tokens(F.col("url")))
    mined = None
    if labels is not None:
        key = F.expr(r"try_cast(nullif(regexp_extract(url, '(?s)^.*?://[^?#]*?/([0-9]+)', 1), '') as bigint)")
        known = labels.select("key", "bad").where("key is not null and bad is not null").groupBy("key").agg(F.max("bad").alias("bad"))
        items = materialize(pages.where("size(tokens) > 0").select(key.alias("key"), "tokens").join(known, "key").select("tokens", "bad"), "url-items")
        if not items.isEmpty():
            mined = mine_rules(items, min_support, min_confidence)
    judged = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    judged = judged.withColumn("given", given_rule(F.col("host"), F.col("path"), rules))
    if mined is None:
        judged = judged.withColumn("mined_rule", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    else:
        # One row per distinct token list: pages of a hot host are tested once.
        lists = pages.select("tokens").distinct()
        hits = (
            lists.withColumn("posting", F.explode("tokens")).join(mined, "posting")
            .where(F.size(F.array_except("antecedent", "tokens")) == 0)
            .groupBy("tokens").agg(F.max(F.struct("confidence", "rule_id")).alias("best"))
        )
        judged = salted_join(judged.withColumn("tokens", tokens(F.col("url"))), hits, "tokens", "page_id").withColumn("mined_rule", F.col("best.rule_id")).withColumn("confidence", F.col("best.confidence"))
    verdict = F.coalesce(F.col("given.verdict"), F.when(F.col("mined_rule").isNotNull(), "block"), F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), "mined_rule", "confidence")
