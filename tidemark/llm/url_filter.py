"""URL filters: listed rules, and gradient-boosted trees on lexical features.

Rules name a host and a path; the longest that fits decides. What no rule
fits is judged by trees that are trained on the URLs that rules have labelled.
Features are lengths, depths, digit shares, entropy, parameters and how often
the host's suffix was blocked among all labelled pages. A URL that trains the
trees gets that rate from the URLs of the other folds, so that it does not
hold the URL's own label.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

# The rules.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
TRAIN_URLS = 50_000
URL_FOLDS = 5
FEATURES = ["n_url", "n_host", "n_path", "host_depth", "path_depth", "digits", "host_digits", "hyphens", "entropy", "parameters", "fragment", "suffix_rate", "suffix_seen"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null and without ://."""
    url = F.coalesce(url, F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(url, parts, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits of entropy of the characters of a text, 0 for an empty one."""
    n = F.length(text)
    letters = F.filter(F.split(text, ""), lambda c: c != "")

    def bits(x: Column) -> Column:
        share = lambda c: F.size(F.filter(x, lambda y: y == c)) / F.size(x)
        return F.aggregate(F.transform(F.array_distinct(x), share), F.lit(0.0), lambda s, p: s - p * F.log2(p))

    return F.when(n > 0, F.get(F.transform(F.array(letters), bits), F.lit(0))).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """Add host, path, suffix and the lexical features of ``url``."""
    host, path = host_and_path(F.col("url"))
    url = F.coalesce("url", F.lit(""))
    share = lambda x: F.regexp_count(x, F.lit("[0-9]")) / F.greatest(F.length(x), F.lit(1))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    named = pages.withColumn("host", host).withColumn("path", path)
    values = {
        "n_url": F.length(url),
        "n_host": F.length("host"),
        "n_path": F.length("path"),
        "host_depth": F.size(F.split("host", r"\.")),
        "path_depth": F.regexp_count("path", F.lit("/")),
        "digits": share(url),
        "host_digits": share(F.col("host")),
        "hyphens": F.regexp_count("host", F.lit("-")),
        "entropy": _entropy(F.concat("host", "path")),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "fragment": url.contains("#").cast("int"),
    }
    return named.withColumns({k: v.cast("double") for k, v in values.items()}).withColumn("suffix", F.element_at(F.split("host", r"\."), -1))


def _rate(s: Column, n: Column, prior: float, strength: float = 10.0) -> list[Column]:
    return [((s + strength * prior) / (n + strength)).alias("suffix_rate"), F.log1p(n).alias("suffix_seen")]


def suffix_rates(counts: DataFrame, prior: float) -> DataFrame:
    """(suffix, suffix_rate, suffix_seen): share of blocked pages, smoothed to ``prior``."""
    sums = counts.groupBy("suffix").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select("suffix", *_rate(F.col("s"), F.col("n"), prior))


def suffix_rates_of_others(counts: DataFrame, prior: float) -> DataFrame:
    """(suffix, fold, suffix_rate, suffix_seen) of the pages of all other folds."""
    own = counts.groupBy("suffix", "fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = counts.groupBy("suffix").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    return own.join(total, "suffix").select("suffix", "fold", *_rate(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n"), prior))


def judge_urls(pages: DataFrame, rules=RULES, most: int = TRAIN_URLS, trees: int = 20, depth: int = 4) -> DataFrame:
    """Add host, path, rule, verdict and score to a table with ``url``.

    The trees learn from at most ``most`` of the distinct URLs that rules
    decide, the ones of smallest hash, each weighed by how often it occurs;
    suffix rates count all pages that rules decide. ``score`` is the trees'
    probability of ``block``. With labels of one kind only, or none, the score
    is the smoothed share of blocked pages among the labelled. Null, empty and
    malformed URLs have an empty host and path and are judged by their
    features; equal URLs get equal verdicts; an empty table gives no rows;
    other columns stay, but for ones named as the five that are added.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    added = ["host", "path", "rule", "verdict", "score"]
    stays = [c for c in pages.columns if c not in added]
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    known = lexical(pages.select(F.struct(*stays).alias("row"), "url")).withColumn("rule", rule).withColumn("said", said)
    lexical_features = [c for c in FEATURES if not c.startswith("suffix")]
    h = F.xxhash64("url")
    labelled = known.where("said is not null").select("suffix", *lexical_features, h.alias("h"), F.pmod(h, F.lit(URL_FOLDS)).alias("fold"), (F.col("said") == "block").cast("double").alias("label"))
    counts = keep(labelled.groupBy("suffix", "fold").agg(F.sum("label").alias("s"), F.count("*").alias("n")), "suffixes")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s")).first()
    p = float((total.s + 0.5) / (total.n + 1))
    fill = {"suffix_rate": p, "suffix_seen": 0.0}
    full = known.join(suffix_rates(counts, p), "suffix", "left").fillna(fill)
    last = labelled.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    few = labelled.where(F.col("h") <= F.lit(last)).groupBy("h", "fold", "suffix", "label", *lexical_features).agg(F.count("*").cast("double").alias("weight"))
    sample = keep(few.join(suffix_rates_of_others(counts, p), ["suffix", "fold"], "left").fillna(fill), "urls")
    if sample.select("label").distinct().count() == 2:
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
        grown = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", predictionCol="class", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=5).setProbabilityCol("p").setRawPredictionCol("raw")
        model = grown.fit(assemble.transform(sample.orderBy("h")))
        full = model.transform(assemble.transform(full)).withColumn("score", vector_to_array("p")[1])
    else:
        full = full.withColumn("score", F.lit(p))
    verdict = F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return full.withColumn("verdict", verdict).select("row.*", *added)
