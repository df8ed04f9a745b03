"""URL filter: explicit rules first, then a character language-model ratio. DataFrame functions only.

URLs that an allow rule fits train the accepted model, those that a block rule
fits the rejected one. Both are variable-order Markov models over characters:
the probability of a character after its longest context is interpolated with
those of all shorter contexts (Witten-Bell), down to a uniform one. A URL's
score is the mean log ratio per character of the two; the threshold is the one
with the least balanced error on a fifth of the ruled URLs, kept out of the
counts. Counts cover all other ruled URLs.

Models are tables keyed by the characters themselves. Each distinct run of
``ORDER`` characters is scored once, and URLs are joined to those scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import by_class, lower_ascii, private, stored, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 5
ALPHABET = 256
BROADCAST_GRAMS = 1_000_000  # a run has at most 20 bytes: under 64 MB
START, END = "\u0002", "\u0003"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; path: then up to ``?``, ``#`` or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host and subdomains, and paths that start with its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, tail = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(url: Column) -> Column:
    """For each character and the end sign: it and the ORDER - 1 characters ahead of it."""
    padded = F.concat(F.lit(START * (ORDER - 1)), url, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(url) + 1), lambda i: F.substring(padded, i, ORDER))


def _counts(training: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grams of every order with their counts in each class; contexts with totals and numbers of successors."""
    longest = training.select("n_allow", "n_block", F.explode(_grams(F.col("url"))).alias("g")).groupBy("g").agg(
        F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block"))
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(ORDER)), lambda n: F.substring("g", ORDER + 1 - n, n))
    grams = stored(longest.select("n_allow", "n_block", F.explode(suffixes).alias("g")).groupBy("g").agg(
        F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block")), "grams")
    contexts = grams.groupBy(F.substring("g", F.lit(1), F.length("g") - 1).alias("c")).agg(
        *[F.sum(f"n_{k}").alias(f"all_{k}") for k in ("allow", "block")],
        *[F.count_if(F.col(f"n_{k}") > 0).alias(f"kinds_{k}") for k in ("allow", "block")])
    return grams, contexts


def gram_scores(wanted: DataFrame, training: DataFrame) -> DataFrame:
    """(g, llr): log ratio of the last character's probability, accepted over rejected, for each distinct run in ``wanted``.

    Probabilities are built from the shortest context up. The runs of one length
    meet their counts by the run, their context's by all but the last character
    and the probability after the shorter context by all but the first: no key of
    these joins has more rows than there are different characters.
    """
    grams, contexts = _counts(training)
    wanted = stored(wanted.select("g").distinct(), "runs")
    known = None
    for n in range(1, ORDER + 1):
        runs = wanted.select(F.substring("g", ORDER + 1 - n, n).alias("g")).distinct()
        runs = runs.withColumn("c", F.substring("g", 1, n - 1)).withColumn("s", F.substring("g", 2, n - 1))
        here = contexts.where(F.length("c") == n - 1)
        found = runs.join(grams.where(F.length("g") == n), "g", "left").join(F.broadcast(here) if n == 1 else here, "c", "left")
        if n > 1:
            found = found.join(known.withColumnRenamed("g", "s"), "s")

        def probability(k: str) -> Column:
            seen, total, kinds = (F.coalesce(f"{s}_{k}", F.lit(0)) for s in ("n", "all", "kinds"))
            shorter = F.col(f"p_{k}") if n > 1 else F.lit(1.0 / ALPHABET)
            return F.when(total > 0, (seen + kinds * shorter) / (total + kinds)).otherwise(shorter)

        known = found.select("g", *[probability(k).alias(f"p_{k}") for k in ("allow", "block")])
    return known.select("g", (F.log("p_allow") - F.log("p_block")).alias("llr"))


def url_scores(urls: DataFrame) -> DataFrame:
    """(url, verdict, score) of each row of ``urls`` (url, n, verdict): distinct urls, their rows and the rule's verdict or null."""
    fold = F.pmod(F.xxhash64("url"), F.lit(5))
    training = urls.where(F.col("verdict").isNotNull() & (fold != 0)).select("url", *[
        F.when(F.col("verdict") == k, F.col("n")).otherwise(0).alias(f"n_{k}") for k in ("allow", "block")])
    scored = urls.where(F.col("verdict").isNull() | (fold == 0))
    runs = scored.select("url", F.explode(_grams(F.col("url"))).alias("g"))
    known = stored(gram_scores(runs, training), "llr")
    if known.count() <= BROADCAST_GRAMS:
        known = F.broadcast(known)
    score = runs.join(known, "g").groupBy("url").agg(F.avg("llr").alias("score"))
    return scored.select("url", "n", "verdict").join(score, "url")


def threshold(scores: DataFrame) -> float:
    """The score with the least balanced error between ruled URLs of both verdicts; 0 without either.

    Scores go into at most 8,001 bins, whose counts are all that is ordered and fetched.
    """
    binned = scores.where("verdict IS NOT NULL").groupBy(F.greatest(F.lit(-4000), F.least(F.lit(4000), F.floor(F.col("score") * 200))).alias("bin"))
    bins = binned.agg(*[F.sum(F.when(F.col("verdict") == k, F.col("n")).otherwise(0)).alias(k) for k in ("allow", "block")])
    below, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    lost = F.coalesce(F.sum("allow").over(below), F.lit(0)) / F.sum("allow").over(every)
    passed = 1 - F.coalesce(F.sum("block").over(below), F.lit(0)) / F.sum("block").over(every)
    best = bins.select("bin", (lost + passed).alias("error")).where("error IS NOT NULL").orderBy("error", F.abs("bin"), "bin").first()
    return best["bin"] / 200 if best else 0.0


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    A null url counts as empty; without ``://`` host and path are empty and no
    rule fits. Where no rule fits, the verdict is allow if the score is at
    least the threshold. Score is null where a rule decides. With no ruled URL
    of one kind the score compares with 0, and with none at all every score is
    0, so allow. Repeated rows get a row each; null ids stay null.
    """
    host, path = host_and_path(F.col("url"))
    rows = private(pages, "page_id", "url").select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), says.alias("ruled"))
    urls = stored(rows.groupBy("url", F.col("ruled").alias("verdict")).agg(F.count(F.lit(1)).alias("n")), "urls")
    scores = stored(url_scores(urls), "url-scores")
    least = threshold(scores)
    open_scores = scores.where("verdict IS NULL").select("url", "score", F.col("n").alias("members"))
    method = F.when(F.col("score") >= least, "allow").otherwise("block")
    judged = by_class(rows.where("ruled IS NULL"), open_scores, "url", most=100_000).select(
        "page_id", "host", "path", "rule", method.alias("verdict"), "score")
    return judged.unionByName(rows.where("ruled IS NOT NULL").select(
        "page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score")))


def op6_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))
