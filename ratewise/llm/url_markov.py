"""URL filter: rules first, then a character language-model ratio.

Two variable-order Markov models, one of the URLs that rules allow and one of
those they block, give each character a probability after up to ``order``
characters before it; Witten-Bell smoothing backs off from long contexts to
short ones. A URL's score is the mean log-likelihood difference per character,
and the cut is set on ruled URLs that the models have not seen.

Every table is a count of (order + 1)-grams or derives from one: the corpus is
exploded to grams twice, first to count them and then to score.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, number_sorted

#: Characters of the alphabet that the shortest context backs off to.
ALPHABET = 256
#: Width of the score classes among which the cut is chosen.
STEP = 0.01


def split_url(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(rules) -> tuple[Column, Column]:
    """The longest rule that fits columns host and path, and its verdict; null if none does."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, decision in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found, verdict = F.when(fits, host + path).otherwise(found), F.when(fits, decision).otherwise(verdict)
    return found, verdict


def grams(urls: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row per character and the end of each url: the characters of its context and itself."""
    chars = F.regexp_extract_all(F.concat(F.lit("\u0002" * order), "url", F.lit("\u0003")), F.lit("(?s)."), F.lit(0))
    rows = urls.select(*keep, chars.alias("c"))
    rows = rows.select(*keep, "c", F.explode(F.sequence(F.lit(1), F.size("c") - order)).alias("i"))
    return rows.select(*keep, F.concat(*[F.element_at("c", F.col("i") + k) for k in range(order + 1)]).alias("gram"))


def log_ratios(counts: DataFrame, order: int) -> DataFrame:
    """(gram, ratio) from (gram, a, b): log P(last character | context), allowed less blocked."""
    lower = None
    for k in range(order + 1):
        level = counts.select(F.expr(f"right(gram, {k + 1})").alias("s"), "a", "b").groupBy("s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        level = level.withColumn("ctx", F.expr(f"left(s, {k})"))
        around = level.groupBy("ctx").agg(
            F.sum("a").alias("na"), F.sum("b").alias("nb"),
            F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum((F.col("b") > 0).cast("long")).alias("tb"))
        level = level.join(around, "ctx")
        if lower is None:
            level = level.withColumn("qa", F.lit(1.0 / ALPHABET)).withColumn("qb", F.lit(1.0 / ALPHABET))
        else:
            level = level.withColumn("tail", F.expr(f"right(s, {k})")).join(lower, "tail")

        def smooth(c, n, t, q):
            return F.when(F.col(n) > 0, (F.col(c) + F.col(t) * F.col(q)) / (F.col(n) + F.col(t))).otherwise(F.col(q))

        level = level.select("s", smooth("a", "na", "ta", "qa").alias("pa"), smooth("b", "nb", "tb", "qb").alias("pb"))
        lower = level.select(F.col("s").alias("tail"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
    return lower.select(F.col("tail").alias("gram"), (F.ln("qa") - F.ln("qb")).alias("ratio"))


def calibrate(scored: DataFrame) -> float:
    """The cut with the best sum of allowed shares at or above it and blocked shares under it; 0 without both.

    ``scored`` has score and allowed. Counts by score class reach the driver:
    their number is bounded by the range of a mean log ratio over ``STEP``.
    """
    bins = scored.groupBy(F.floor(F.col("score") / STEP).alias("bin")).agg(
        F.sum(F.col("allowed").cast("long")).alias("a"), F.sum((~F.col("allowed")).cast("long")).alias("b")).collect()
    bins = sorted((r["bin"], r["a"], r["b"]) for r in bins)
    good, bad = sum(x[1] for x in bins), sum(x[2] for x in bins)
    if not good or not bad:
        return 0.0
    best, cut, above, under = -1.0, 0.0, good, 0
    for at, a, b in bins:
        if (value := above / good + under / bad) > best:
            best, cut = value, at * STEP
        above, under = above - a, under + b
    return cut


def judge(pages: DataFrame, rules, order: int = 4, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score (null where a rule decides).

    A rule is (host, path, "allow" or "block"). Null urls and urls without
    ``://`` have an empty host and path, fit no rule and are scored as they
    are (null as the empty url). Equal urls are judged once and have one
    verdict. Ties go to allow. Without ruled urls of both kinds the models are
    equal or one-sided and the cut is 0. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    host, path = split_url("url")
    distinct = rows.select("url").distinct().withColumn("host", host).withColumn("path", path)
    rule, verdict = match_rule(rules)
    distinct = distinct.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("held", F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin("0", "1", "2"))
    urls = number_sorted(distinct.sortWithinPartitions("url"), "uid", "urls")
    learn = ~F.col("held") & F.col("ruled").isNotNull()
    spelled = grams(urls, order, "uid", "ruled", "held")
    counts = spelled.groupBy("gram").agg(
        F.sum((learn & (F.col("ruled") == "allow")).cast("long")).alias("a"), F.sum((learn & (F.col("ruled") == "block")).cast("long")).alias("b"))
    counts = materialize(counts.na.fill(0, ["a", "b"]), "grams")
    ratios = materialize(log_ratios(counts, order), "ratios")
    need = urls.where("ruled is null or held")
    scores = grams(need, order, "uid").join(ratios, "gram").groupBy("uid").agg(F.avg("ratio").alias("score"))
    scored = materialize(urls.join(scores, "uid", "left").drop("uid"), "scored")
    cut = calibrate(scored.where("held and ruled is not null").select("score", (F.col("ruled") == "allow").alias("allowed")))
    own = F.when(F.col("score") >= cut, "allow").otherwise("block")
    judged = scored.select("url", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.when(F.col("ruled").isNull(), F.col("score")).alias("score"))
    return rows.join(judged, "url").select("page_id", "host", "path", "rule", "verdict", "score")
