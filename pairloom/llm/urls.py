"""URL filters (1) in DataFrame functions only: FP-growth mines URL token combinations that go with bad labels.

Rules ``{tokens} -> block`` are kept above a support and a confidence and dropped when part of their
tokens does as well. Single tokens are counted, so for them the support is a number of rows at every size. The rules stand in an inverted index under their rarest token: a URL meets only the rules whose
rarest token it has. Explicit (host, path) rules come first.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host and path) of the explicit rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Bad labelled URLs that a rule must hold for; a combination of tokens must also hold for a share of all labelled URLs. The
#: share bounds what FP-growth sends to the driver: at most (tokens of a URL) / share frequent tokens.
MIN_COUNT, MIN_SHARE = 10, 0.0001
MIN_CONFIDENCE = 0.6
BLOCK = "label=block"
#: Rules that may be broadcast; more are joined by token.
BROADCAST_RULES = 50_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.translate(_cut(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return _cut(url, 2)


def _cut(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*+://([^/?#]*+)([^?#]*+)", group), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path segments with runs of digits as 0, query parameters, fragment."""
    host, path = url_host(url), url_path(url)
    after = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*+)", 1), F.lit(""))
    mark = F.coalesce(F.regexp_extract(url, r"(?s)#(.*+)", 1), F.lit(""))
    some = lambda text, at, kind: F.transform(F.filter(F.split(text, at), lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.regexp_replace(x, "[0-9]+", "0")))
    return F.array_distinct(F.concat(some(host, r"\.", "host="), some(path, "/", "path="), some(after, "&", "query="), some(mark, "&", "mark=")))


def explicit_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; a rule's host also stands for its subdomains."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        of, slash, start = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def mine_rules(urls: DataFrame, tokens: str = "tokens", bad: str = "bad", min_share: float = MIN_SHARE,
               min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(antecedent, confidence, support, anchor) from labelled rows; ``bad`` is boolean, null labels are left out.

    ``anchor`` is the antecedent's rarest token. All tokens are mined, also those of nearly all rows. A token alone
    needs ``min_count`` bad rows, a combination also ``min_share`` of the rows.
    """
    spark = urls.sparkSession
    rows = stored(urls.where(F.col(bad).isNotNull()).select(F.col(tokens).alias("tokens"), F.col(bad).alias("bad")), "labelled-urls")
    n, n_bad = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("bad"), 1))).first()
    if n_bad < min_count:
        return spark.range(0).selectExpr("array('') antecedent", "0D confidence", "0D support", "'' anchor")
    seen = rows.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bad"), 1)).alias("n_bad"))
    frequent = stored(seen.where(F.col("n") >= min_count), "url-tokens")
    alone = (frequent.select(F.array("token").alias("antecedent"), (F.col("n_bad") / F.col("n")).alias("confidence"), (F.col("n_bad") / F.lit(n)).alias("support"), "n_bad")
             .where((F.col("n_bad") >= min_count) & (F.col("confidence") >= min_confidence)).drop("n_bad"))
    least = max(math.ceil(min_share * n), min_count)
    items = rows.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min_confidence).fit(items)
    rules = (model.associationRules.where((F.col("consequent") == F.array(F.lit(BLOCK))) & (F.size("antecedent") > 1))
             .select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support").unionByName(alone))
    rarest = (rules.select("antecedent", F.explode("antecedent").alias("token")).join(frequent, "token")
              .groupBy("antecedent").agg(F.min_by("token", F.struct("n", "token")).alias("anchor")))
    rules = stored(rules.join(rarest, "antecedent"), "url-rules")
    # A rule goes when another with part of its tokens is as sure.
    own = rules.select(F.col("antecedent").alias("tokens"), F.col("confidence").alias("own"))
    less = matches(own, rules).where((F.size("antecedent") < F.size("tokens")) & (F.col("confidence") >= F.col("own")))
    return stored(rules.join(less.select(F.col("tokens").alias("antecedent")).distinct(), "antecedent", "left_anti"), "url-rules")


def matches(rows: DataFrame, rules: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Rows with each rule whose tokens they all have, found through the index of anchors."""
    index = F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules
    met = rows.withColumn("_llm_token", F.explode(tokens)).join(index, F.col("_llm_token") == F.col("anchor"))
    return met.where(F.size(F.array_except("antecedent", tokens)) == 0).drop("_llm_token")


def judge_urls(pages: DataFrame, labels: DataFrame, url: str = "url", page_id: str = "page_id", label_id: str = "doc_id",
               bad: Column | None = None, rules=RULES, **how) -> DataFrame:
    """Add host, path, rule, verdict, mined_rule, confidence to every row of ``pages``.

    ``bad`` (over the columns of ``labels``, default quality 0 or toxic 1) marks bad labels; a page with several labels is
    bad if one is. The verdict is the explicit rule's, else block where a mined rule fits, else allow.
    Null urls and urls without ``://`` have empty host and path, no rule, and are allowed. Repeated rows are judged alike;
    without labels nothing is mined. Columns of ``pages`` with a result's name are replaced.
    """
    bad = bad if bad is not None else (F.col("quality") == 0) | (F.col("toxic") == 1)
    marks = labels.select(F.col(label_id).alias("_llm_id"), bad.alias("_llm_bad")).where(F.col("_llm_id").isNotNull()).groupBy("_llm_id").agg(F.max("_llm_bad").alias("_llm_bad"))
    labelled = pages.select(F.col(page_id).alias("_llm_page"), F.col(url).alias("_llm_url")).join(marks, F.col("_llm_page") == F.col("_llm_id"))
    mined = mine_rules(labelled.select(url_tokens(F.col("_llm_url")).alias("tokens"), F.col("_llm_bad").alias("bad")), **how)
    urls = pages.select(F.col(url).alias("_llm_url")).where(F.col("_llm_url").isNotNull()).distinct()
    open_urls = urls.where(explicit_rule(url_host(F.col("_llm_url")), url_path(F.col("_llm_url")), rules).isNull())
    found = matches(open_urls.withColumn("tokens", url_tokens(F.col("_llm_url"))), mined)
    best = found.groupBy("_llm_url").agg(F.max(F.struct("confidence", "support", F.array_join("antecedent", " ").alias("rule"))).alias("_llm_best"))
    joined = pages.join(best, F.col(url) == F.col("_llm_url"), "left")
    host, path = url_host(F.col(url)), url_path(F.col(url))
    plain = explicit_rule(host, path, rules)
    made = {"host": host, "path": path, "rule": plain["rule"],
            "verdict": F.coalesce(plain["verdict"], F.when(F.col("_llm_best").isNotNull(), "block").otherwise("allow")),
            "mined_rule": F.col("_llm_best.rule"), "confidence": F.col("_llm_best.confidence")}
    return joined.select(*[F.col(c) for c in pages.columns if c not in made], *[v.alias(k) for k, v in made.items()])
