"""URL filters: rules by host and path first, gradient-boosted trees on lexical features for all other urls.

The trees are trained from labelled urls: those that a rule decides, and of all others those whose host has a word of the
seed list of unwanted sites. Features are length, depth, digit ratio, entropy of the characters, counts of
parameters and marks, and statistics of suffixes: how often labelled urls of one site, of one zone (both suffixes of hosts) and of
one kind of file (suffix of the path, with its first part) are to be blocked. A labelled url never counts in its own statistics: it gets
those of the other folds. Training and prediction are DataFrame operations and Spark's own tree learner; no Python
runs on executors.

Defined results: a null url, or one without ://, has an empty host and path, no rule, and is allowed; repeated rows
get equal results; a repeated url is one labelled url, to be blocked if any of its labels says so; equal hashes are ordered by url;
urls of any length are read whole; without labelled urls of both kinds there are no trees and all other urls are allowed;
a score of one half allows; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unit_hash

#: (rule, verdict); a rule is a host, with all its subdomains, and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words of hosts that label a url as unwanted.
SEEDS = ("casino", "bets", "betting", "poker", "pills", "viagra", "porn", "adult", "xxx", "spam", "ads", "track", "malware", "phish")
#: Bound on the labelled urls that trees are trained on, those with the smallest hashes.
SAMPLE = 20_000
TREES, DEPTH = 12, 4
#: Parts of the labelled urls; a labelled url gets the suffix statistics of the other parts. Weight of one half in each rate.
FOLDS, PRIOR = 5, 2.0

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIXES = ("site", "zone", "kind")
FEATURES = ("f_length", "f_host_length", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_entropy", "f_params", "f_hyphens", "f_query", "f_fragment", "f_www", "f_file", "f_https", *(f"f_{s}_rate" for s in SUFFIXES))


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UP, _LOW), F.coalesce(path, F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: -len(r[0])):
        of, slash, under = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + under)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule, verdict)


def _lexical(df: DataFrame) -> DataFrame:
    url, host = F.coalesce("url", F.lit("")), F.col("host")
    share = lambda c: F.length(F.regexp_replace(c, r"[^0-9]", "")) / F.greatest(F.length(c), F.lit(1))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    chars = F.array_distinct(F.regexp_extract_all(url, F.lit("(?s)."), F.lit(0)))
    times = F.transform(chars, lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))).cast("double"))
    entropy = F.aggregate(times, F.lit(0.0), lambda a, c: a - (c / n) * F.log2(c / n))
    labels = F.split(host, r"\.")
    return df.withColumns({
        "f_length": F.length(url).cast("double"), "f_host_length": F.length(host).cast("double"), "f_depth": F.size(F.split("path", "/")).cast("double"), "f_labels": F.size(labels).cast("double"),
        "f_digits": share(url), "f_host_digits": share(host), "f_entropy": entropy, "f_params": F.size(F.split(url, "[=]")).cast("double") - 1, "f_hyphens": F.size(F.split(host, "-")).cast("double") - 1,
        "f_query": url.contains("?").cast("double"), "f_fragment": url.contains("#").cast("double"), "f_www": host.startswith("www.").cast("double"),
        "f_file": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"), "f_https": url.startswith("https").cast("double"),
        "site": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), "."), "zone": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        "kind": F.concat(F.lower(F.regexp_extract("path", r"^/([^/]*)/", 1)), F.lit("/*"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1))),
    })


def label(host: Column, verdict: Column, seeds: Sequence[str] = SEEDS) -> Column:
    """1 for urls to block, 0 for urls to allow, null where nothing is known; a rule's verdict comes before the seeds."""
    bad = host.rlike(r"(^|[^a-z])(" + "|".join(seeds) + r")([^a-z]|$)")
    return F.when(verdict == "allow", 0.0).when(verdict == "block", 1.0).when(bad, 1.0)


class Model:
    """Suffix statistics and trees; trees are None without labelled urls of both kinds."""

    def __init__(self, labelled: DataFrame, sample: int = SAMPLE):
        """labelled: url, host, path and label (0.0 or 1.0); statistics cover all of it, the trees a bounded sample."""
        own = labelled.groupBy("url", "host", "path").agg(F.max("label").alias("label")).withColumn("fold", F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(FOLDS)))
        own = cut(_lexical(own))
        self.counts = {s: cut(own.groupBy(F.col(s).alias("of"), F.col("fold").alias("in_fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))) for s in SUFFIXES}
        some = cut(self.vectors(own.orderBy(unit_hash("url"), "url").limit(sample).repartition(4), True).select("features", "label"))
        self.trees = None
        if some.agg(F.count_distinct("label")).first()[0] == 2:
            self.trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11, maxBins=32, cacheNodeIds=False).fit(some)

    def use(self) -> dict[str, float]:
        """How much each feature decides, as shares of 1; empty without trees."""
        return {} if self.trees is None else dict(zip(FEATURES, self.trees.featureImportances.toArray().tolist()))

    def rated(self, lexical: DataFrame, held: bool = False) -> DataFrame:
        """With the rate of each suffix; held: without the fold of the row itself."""
        for s in SUFFIXES:
            all_ = self.counts[s].groupBy(F.col("of").alias("of_all")).agg(F.sum("n").alias("n_all"), F.sum("bad").alias("bad_all"))
            lexical = lexical.join(all_, F.col(s) == F.col("of_all"), "left")
            n, bad = F.coalesce("n_all", F.lit(0)), F.coalesce("bad_all", F.lit(0.0))
            if held:
                lexical = lexical.join(self.counts[s], (F.col(s) == F.col("of")) & (F.col("fold") == F.col("in_fold")), "left")
                n, bad = n - F.coalesce("n", F.lit(0)), bad - F.coalesce("bad", F.lit(0.0))
            lexical = lexical.withColumn(f"f_{s}_rate", (bad + PRIOR / 2) / (n + PRIOR)).drop("of_all", "n_all", "bad_all", "of", "in_fold", "n", "bad")
        return lexical

    def vectors(self, lexical: DataFrame, held: bool = False) -> DataFrame:
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(self.rated(lexical, held))

    def blocked(self, urls: DataFrame) -> DataFrame:
        """urls with the column score: the probability that a url is to be blocked; 0 without trees."""
        if self.trees is None:
            return urls.withColumn("score", F.lit(0.0))
        return self.trees.transform(self.vectors(_lexical(urls))).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every url. labelled (url, label) takes the place of the labels from rules and seeds."""
    host, path = host_path(F.col("url"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").withColumns({"host": host, "path": path})
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "by_rule": verdict})
    if labelled is None:
        known = own.withColumn("label", label(F.col("host"), F.col("by_rule"))).where("label is not null and host <> ''").select("url", "host", "path", "label")
    else:
        known = labelled.select("url", F.col("label").cast("double").alias("label")).withColumns({"host": host, "path": path})
    scored = Model(known).blocked(own)
    by_tree = F.when((F.col("host") != "") & (F.col("score") > 0.5), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_tree).alias("verdict"), "score")
