"""URL filtering: rules first, then gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs: the URLs that the rules judge, or labels that the caller has. All features come
from built-in column expressions; training and scoring stay in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import ascii_lower, stash

FEATURES = ("length", "host_length", "depth", "digits", "entropy", "params", "hyphens", "labels", "path_length", "long_host_label", "suffix_rate", "suffix_log_count")
#: Distinct labelled URLs that the trees are fitted on, at most; those with the smallest hash of (seed, URL).
TRAIN_URLS = 20_000
#: Folds of the suffixes' rates in training, labels that the overall rate counts for, and suffixes up to which their statistics are broadcast, about 150 bytes each; beyond, they are joined by a shuffle.
FOLDS, PRIOR_LABELS, BROADCAST_SUFFIXES = 5, 20.0, 200_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(text: str, action: str) -> Rule:
    """``host/path`` as a rule; its path starts with the slash."""
    host, slash, path = text.partition("/")
    return Rule(host, slash + path, action)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, action) of the longest rule that fits, or nulls. The rules are a short list that the caller gives."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, action = F.when(fits, r.text).otherwise(text), F.when(fits, r.action).otherwise(action)
    return text, action


def _entropy(text: Column) -> tuple[Column, Column]:
    """The characters, to be had as ``_chars``, and the bits a character, from the sorted characters: run lengths are differences of where runs end."""
    chars = F.array_sort(F.split(text, ""))
    n = F.length(text)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.element_at(F.col("_chars"), i) != F.element_at(F.col("_chars"), F.least(i + 1, n))))
    return chars, F.when(n > 0, F.aggregate(
        ends,
        F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("h")),
        lambda acc, e: F.struct(e.alias("at"), (acc["h"] - (e - acc["at"]) / n * F.log2((e - acc["at"]) / n)).alias("h")),
        lambda acc: acc["h"],
    )).otherwise(0.0)


def lexical_features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path, ...) with the lexical features and ``suffix``: the last two labels of the host."""
    url = F.coalesce("url", F.lit(""))
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    host_labels = F.split("host", r"\.")
    chars, entropy = _entropy(url)
    # The characters are made once, before the lambdas that look into them.
    with_chars = urls.select("*", F.explode(F.array(F.filter(chars, lambda c: c != ""))).alias("_chars"))
    return with_chars.select(
        *urls.columns,
        F.length(url).cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.length(F.regexp_replace("path", "[^/]", "")).cast("double").alias("depth"),
        F.when(F.length(url) > 0, digits / F.length(url)).otherwise(0.0).alias("digits"),
        entropy.alias("entropy"),
        F.when(F.instr(url, "?") > 0, F.length(F.regexp_replace(url, "[^&]", "")) + 1).otherwise(0).cast("double").alias("params"),
        F.length(F.regexp_replace("host", "[^-]", "")).cast("double").alias("hyphens"),
        F.size(host_labels).cast("double").alias("labels"),
        F.length("path").cast("double").alias("path_length"),
        F.array_max(F.transform(host_labels, F.length)).cast("double").alias("long_host_label"),
        suffix_of(F.col("host")).alias("suffix"),
    )


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """(suffix, urls, labelled, blocked, fold_labelled, fold_blocked) of all ``rows`` (url, host, block: 0, 1 or null); the last two by fold of the URL."""
    label = F.col("block").isNotNull().cast("int")
    by_fold = rows.groupBy(suffix_of(F.col("host")).alias("suffix"), _fold(F.col("url")).alias("fold")).agg(F.count(F.lit(1)).alias("urls"), F.sum(label).alias("labelled"), F.coalesce(F.sum("block"), F.lit(0)).alias("blocked"))
    per = lambda c: F.array(*(F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(c))), F.lit(0)) for k in range(FOLDS))).alias(f"fold_{c}")
    return by_fold.groupBy("suffix").agg(*(F.sum(c).alias(c) for c in ("urls", "labelled", "blocked")), per("labelled"), per("blocked"))


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS))


def _rate(blocked: Column, labelled: Column, prior: float) -> Column:
    """The share of blocked labels, drawn towards ``prior`` by as many as PRIOR_LABELS labels."""
    return (blocked + PRIOR_LABELS * prior) / (labelled + PRIOR_LABELS)


def _with_suffixes(rows: DataFrame, suffixes: DataFrame, prior: float, *, held_out: bool = False) -> DataFrame:
    """``rows`` with their suffix's features; ``held_out``: the rate is that of the other folds' labels."""
    few = F.broadcast(suffixes) if suffixes.count() <= BROADCAST_SUFFIXES else suffixes
    own = [F.element_at(F.col(c), (_fold(F.col("url")) + 1).cast("int")) if held_out else F.lit(0) for c in ("fold_blocked", "fold_labelled")]
    rate = _rate(F.coalesce(F.col("blocked") - own[0], F.lit(0)), F.coalesce(F.col("labelled") - own[1], F.lit(0)), prior)
    joined = rows.join(few, "suffix", "left").withColumns({"suffix_rate": rate, "suffix_log_count": F.log1p(F.coalesce("urls", F.lit(0)).cast("double"))})
    return joined.drop(*(c for c in suffixes.columns if c != "suffix"))


@dataclass
class UrlModel:
    """Fitted trees with the suffix statistics that they read; ``trees`` is None where all labels agree."""

    trees: object | None
    suffixes: DataFrame
    prior: float

    def score(self, urls: DataFrame) -> DataFrame:
        """``urls`` with ``p_block``: every row's, those that rules judge too."""
        if self.trees is None:
            return urls.withColumn("p_block", F.lit(self.prior))
        rows = _with_suffixes(lexical_features(urls), self.suffixes, self.prior)
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(rows)
        scored = self.trees.transform(vectors)
        return scored.select(*urls.columns, vector_to_array("probability")[1].alias("p_block"))


def fit(urls: DataFrame, *, seed: int = 1, limit: int = TRAIN_URLS, trees: int = 12, depth: int = 4) -> UrlModel:
    """Fit on (url, host, path, block: 0, 1 or null for no label).

    Suffix statistics are of all rows and all labels; while training, a URL's rate leaves out the labels of its fold,
    so that no row sees its own. The trees are fitted on at most ``limit`` distinct labelled URLs.
    """
    suffixes = stash(suffix_statistics(urls), "suffixes")
    sample = (
        urls.where("block IS NOT NULL").groupBy("url", "host", "path")
        .agg(F.max("block").alias("block"))
        .orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("url")).cast("binary")), "url")
        .limit(limit)
    )
    rows = stash(lexical_features(sample).coalesce(1), "urls")
    n, blocked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("block"), F.lit(0))).first()
    prior = blocked / n if n else 0.0
    if blocked in (0, n):
        return UrlModel(None, suffixes, prior)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(_with_suffixes(rows, suffixes, prior, held_out=True))
    gbt = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=seed)
    return UrlModel(gbt.fit(vectors.withColumn("_label", F.col("block").cast("double"))), suffixes, prior)


def judge(pages: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url", threshold: float = 0.5, seed: int = 1, limit: int = TRAIN_URLS) -> DataFrame:
    """Each row of ``pages`` as (key, url, host, path, rule, p_block, verdict).

    A rule's action is final; other URLs get the trees' verdict: block from ``threshold`` on. The trees are trained
    on the URLs that rules judge.

    Defined cases: null keys take part; a null URL, or one without ``://``, has an empty host and path, meets no rule
    with a host, and is scored like any other (null as the empty text); repeated rows each get the same verdict; an
    empty table gives no rows; without rules that fit, or where all of them agree, the share of blocked labels is the
    score (0 without labels: allow); other columns are left out; of rules of equal length the last by text wins.
    """
    host, path = split_url(F.col(url))
    base = pages.select(F.col(key).alias("_key"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = base.withColumns({"rule": rule, "_action": action})
    model = fit(ruled.select("url", "host", "path", (F.col("_action") == "block").cast("int").alias("block")), seed=seed, limit=limit)
    scored = model.score(ruled)
    verdict = F.coalesce("_action", F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))
    return scored.select(F.col("_key").alias(key), "url", "host", "path", "rule", "p_block", verdict.alias("verdict"))
