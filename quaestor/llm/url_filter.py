"""URL filter by a character language-model ratio.

The URLs that a short list of host and path rules decides are the examples: those allowed are
accepted, those blocked rejected. For each class a variable-order Markov model over characters
is counted from its distinct URLs. A character's probability after two others blends the orders:
the estimate after the long context leans on that after the short one by ``smoothing``
imaginary cases, that on the plain frequency, and that on the uniform one. The score of a URL is
the difference of the two log-likelihoods per character; it is allowed from a threshold on, which
is set on a fifth of the examples that is held out of the counts, where the error rates of
the two classes add up to least.

Characters are folded to 46 symbols, so the model is a complete table of 46**3 = 97,336 numbers
however many URLs there are; that is the proven bound of what is broadcast. Everything is
DataFrame operations, and all sums over URLs are reduced before they are shuffled.

Null URLs and those without ``://`` have an empty host and path and match no rule; they are
scored as the text they are (a null one as an empty one; an empty one scores 0). Without
examples of both classes every URL scores 0. Repeated rows get equal results. Columns beside the
URL are passed through; those named like a result are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.mixing import digest
from quaestor.session import durable, once

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&%"
#: symbols: 0 stands before the first character, the last for every other character
SYMBOLS = len(ALPHABET) + 2
HELD_OUT = 5


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (``host/path``) whose host is the URL's or a parent of it and whose path
    begins the URL's; of equal length the smaller one; else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r), reverse=True):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def grams(frame: DataFrame, *keep: str) -> DataFrame:
    """One row per character of ``url`` (scheme left out, lower-case) with ``code``, the number
    of that character and the two before it."""
    text = F.lower(F.regexp_replace("url", "(?s)^.*?://", ""))

    def symbol(char: Column) -> Column:
        at = F.position(char, F.lit(ALPHABET))
        return F.when(at == 0, SYMBOLS - 1).otherwise(at)

    coded = once(frame.withColumn("_text", text).filter("_text <> ''"), _sym=F.concat(
        F.array(F.lit(0), F.lit(0)), F.transform(F.split("_text", ""), symbol)))
    return coded.select(*keep, F.explode(F.transform(
        F.sequence(F.lit(0), F.size("_sym") - 3),
        lambda i: (F.get("_sym", i) * SYMBOLS + F.get("_sym", i + 1)) * SYMBOLS + F.get("_sym", i + 2))).alias("code"))


def language_models(examples: DataFrame, smoothing: float) -> DataFrame:
    """code, ratio: log of the accepted over the rejected model's probability, for every code."""
    counts = grams(examples, "accepted").groupBy("code").agg(
        F.sum(F.col("accepted").cast("long")).alias("a"), F.sum(1 - F.col("accepted").cast("long")).alias("r"))
    codes = examples.sparkSession.range(SYMBOLS ** 3).select(
        F.col("id").cast("int").alias("code"), F.floor(F.col("id") / (SYMBOLS * SYMBOLS)).alias("x"),
        (F.floor(F.col("id") / SYMBOLS) % SYMBOLS).alias("y"), (F.col("id") % SYMBOLS).alias("z"))
    full = codes.join(counts, "code", "left").fillna(0, ["a", "r"]).withColumn("one", F.lit(1))
    for side in ("a", "r"):
        def seen(*by: str) -> Column:
            return F.sum(side).over(Window.partitionBy(*by))

        full = (full.withColumn("_all", seen("one")).withColumn("_z", seen("z")).withColumn("_y", seen("y"))
                .withColumn("_yz", seen("y", "z")).withColumn("_xy", seen("x", "y")))
        first = (F.col("_z") + smoothing / SYMBOLS) / (F.col("_all") + smoothing)
        second = (F.col("_yz") + smoothing * first) / (F.col("_y") + smoothing)
        full = full.withColumn(f"n{side}", F.col("_all")).withColumn(f"p{side}", (F.col(side) + smoothing * second) / (F.col("_xy") + smoothing))
    both = (F.col("na") > 0) & (F.col("nr") > 0)
    return full.select("code", F.when(both, F.log(F.col("pa") / F.col("pr"))).otherwise(F.lit(0.0)).alias("ratio"))


def best_threshold(held: DataFrame) -> DataFrame:
    """One row: the hundredth from which on to allow, so that the shares of held-out accepted
    examples below it and of rejected ones from it on add up to least; of equal ones the
    nearest to 0, then the smaller. Without examples of both classes it is 0."""
    bins = held.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(
        F.sum(F.col("accepted").cast("long")).alias("a"), F.sum(1 - F.col("accepted").cast("long")).alias("r"))
    bins = bins.unionByName(held.sparkSession.range(1).select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("r")))
    bins = bins.groupBy("bin").agg(F.sum("a").alias("a"), F.sum("r").alias("r")).withColumn("one", F.lit(1))
    whole = Window.partitionBy("one")
    below = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    onward = whole.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    cost = (F.coalesce(F.sum("a").over(below), F.lit(0)) * F.sum("r").over(whole) + F.sum("r").over(onward) * F.sum("a").over(whole))
    return bins.withColumn("cost", cost).groupBy("one").agg(
        F.min(F.struct("cost", F.abs("bin").alias("size"), "bin"))["bin"].alias("threshold"))


def url_filter(pages: DataFrame, rules: dict[str, str], url: str = "url", smoothing: float = 2.0) -> DataFrame:
    """``pages`` with host, path, rule, score, verdict. ``rules``: ``host/path`` to block or allow."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select(F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url")).distinct()
    urls = urls.withColumn("rule", matching_rule(host, path, rules))
    allowed = [r for r, v in rules.items() if v == "allow"]
    urls = durable(urls.withColumn("accepted", F.when(F.col("rule").isNotNull(), F.col("rule").isin(allowed)))
                   .withColumn("held", digest(F.lit("held"), F.col("url")) % HELD_OUT == 0), "urls")
    model = language_models(urls.filter("rule IS NOT NULL AND NOT held"), smoothing)
    scored = grams(urls, "url").join(F.broadcast(model), "code").groupBy("url").agg(F.round(F.avg("ratio"), 6).alias("score"))
    scored = durable(urls.join(scored, "url", "left").fillna(0.0, ["score"]), "scores")
    limit = best_threshold(scored.filter("rule IS NOT NULL AND held"))
    judged = scored.withColumn("one", F.lit(1)).join(F.broadcast(limit), "one").select(
        F.col("url").alias("_url"), "rule", "score", F.floor(F.col("score") * 100) >= F.col("threshold"), "accepted").toDF("_url", "rule", "score", "_pass", "accepted")
    verdict = F.when(F.coalesce("accepted", "_pass"), "allow").otherwise("block")
    frame = pages.drop("host", "path", "rule", "score", "verdict", "_url")
    frame = frame.withColumn("_url", F.coalesce(F.col(url).cast("string"), F.lit("")))
    return (frame.join(judged, "_url").withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
            .withColumn("verdict", verdict).drop("_url", "_pass", "accepted"))
