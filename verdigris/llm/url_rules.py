"""URL filters, with DataFrame operations only.

Fixed rules (host and path prefix) come first. For all other URLs the verdict comes from mined association rules:

1. Tokens of a URL: labels of its host (without a port), segments of its path that hold no digit, names of its query's parameters, its scheme.
2. Spark's FP-growth mines token sets together with the class of labelled pages. Rules "tokens -> block" are kept by support, confidence, a least count of blocked pages and the lower confidence bound of their share, which must be one half, so that few pages make no rule; a rule is dropped when a subset of its tokens gives a rule of at least its confidence.
3. An inverted index holds each rule under the rarest of its tokens. A URL probes the index with its tokens and then compares whole token sets, so it meets few rules.

The rules are written as a table: the optimizer broadcasts them only when they are small.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written

#: Rule and verdict.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: Blocked pages that a rule rests on at least, whatever the support comes to.
MIN_BLOCKED = 5
#: A rule's confidence less its error (Wilson's lower bound at Z standard errors) is at least MIN_BOUND.
Z, MIN_BOUND = 1.96, 0.5
BLOCK = "=block"


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    # A-Z only
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def fixed_rule(h: Column, p: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null. A rule fits its host and all subdomains, if the path starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((h == domain) | h.endswith("." + domain)) & p.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    lower = F.lower(F.coalesce(url, F.lit("")))
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.regexp_extract(lower, r"\?([^#]*)", 1)
    return F.array_sort(
        F.array_distinct(
            F.concat(
                named("s:", F.array(F.regexp_extract(lower, r"^([a-z]+)://", 1))),
                named("h:", F.split(F.regexp_replace(host(lower), ":[0-9]*$", ""), r"\.")),
                named("p:", F.filter(F.split(path(lower), "/"), lambda x: ~x.rlike("[0-9]"))),
                named("q:", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))),
            )
        )
    )


def lower_bound(share: Column, n: Column, z: float = Z) -> Column:
    """Wilson's lower bound of a share that was seen in n rows."""
    return (share + z * z / 2 / n - z * F.sqrt(share * (1 - share) / n + z * z / 4 / n / n)) / (1 + z * z / n)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_blocked: int = MIN_BLOCKED) -> DataFrame:
    """The rules of the rows (tokens, blocked): rule_tokens, anchor (the rarest of them), confidence, support."""
    items = labelled.select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items")).where(F.size("items") > 0)
    items = cut(items)
    if not (n := items.count()):
        return labelled.sparkSession.createDataFrame([], "rule_tokens array<string>, anchor string, confidence double, support double")
    # FP-growth takes the ceiling of support times rows; half a row less is safe from rounding.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, (min_blocked - 0.5) / n)), minConfidence=min_confidence).fit(items)
    blocked = F.round(F.col("support") * n)
    sure = (blocked >= min_blocked) & (lower_bound(F.col("confidence"), blocked / F.col("confidence")) >= MIN_BOUND)
    rules = cut(model.associationRules.where((F.col("consequent") == F.array(F.lit(BLOCK))) & sure).select(F.array_sort("antecedent").alias("rule_tokens"), "confidence", "support"))
    frequency = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    anchors = rules.select("rule_tokens", F.explode("rule_tokens").alias("token")).join(frequency, "token").groupBy("rule_tokens").agg(F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    indexed = cut(rules.join(anchors, "rule_tokens").select("rule_tokens", "anchor", "confidence", "support"))
    # A rule that holds another one of at least its confidence says nothing new. It meets that one as a URL of its tokens would.
    probes = rules.select(F.col("rule_tokens").alias("tokens"), F.col("confidence").alias("least"), F.explode("rule_tokens").alias("anchor"))
    within = (F.size("rule_tokens") < F.size("tokens")) & (F.size(F.array_except("rule_tokens", "tokens")) == 0) & (F.col("confidence") >= F.col("least"))
    told = probes.join(indexed, "anchor").where(within).select(F.col("tokens").alias("rule_tokens")).distinct()
    return written(indexed.join(told, "rule_tokens", "left_anti").select("rule_tokens", "anchor", "confidence", "support"), "rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct url of the rows (url, tokens) that some rule matches: the highest confidence."""
    probes = urls.select("url", "tokens", F.explode("tokens").alias("anchor"))
    hits = probes.join(rules, "anchor").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, confidence (of the mined rule; null without).

    Labels are those of the document of a page's identifier; quality 0 counts as block. Where no fixed rule fits, a mined rule blocks and the rest is allowed. A null url, or one without ``://``, has empty host and path and is allowed unless a mined rule says otherwise; without labels nothing is mined. Null labels and identifiers do not count. Repeated rows are judged alike. An empty table gives no rows.
    """
    pages = pages.select("page_id", "url")
    judged = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("blocked"))
    labelled = pages.join(judged, "page_id").select(tokens(F.col("url")).alias("tokens"), "blocked")
    mined = mine(labelled, min_support, min_confidence)
    told = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    told = told.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    # Only URLs without a fixed rule need the mined ones; each distinct one is matched once.
    open_ = told.where("fixed is null and url is not null").select("url").distinct().select("url", tokens(F.col("url")).alias("tokens"))
    hits = matched(open_, mined).withColumnRenamed("url", "hit_url")
    out = told.join(hits, (F.col("url") == F.col("hit_url")) & F.col("fixed").isNull(), "left")
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "confidence")
