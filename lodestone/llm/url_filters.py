"""URL filters: explicit host/path rules first, gradient-boosted trees on lexical features for the rest.

Features are DataFrame expressions over the url alone; the trees are Spark ML's (JVM), trained on a bounded sample of
labelled urls. Suffix statistics are counted over all labelled urls and joined, by broadcast or shuffle as their size allows; a training
url does not count towards the rate it is fitted with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import Stored, fresh

#: Training rows at most, chosen by hash of the url.
MAX_TRAIN = 15_000
ROUNDS, DEPTH, SEED = 20, 4, 7

#: (verdict, rule); a rule is host + path.
RULES: list[tuple[str, str]] = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_depth", "host_labels", "digit_ratio", "entropy", "parameters", "hyphens", "fragment", "suffix_rows", "suffix_block_rate")


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null or none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"\A([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


def rule_for(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str]] = tuple(RULES)) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. Equal lengths: first in code-point order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, r in sorted(rules, key=lambda x: (len(x[1]), [-ord(c) for c in x[1]])):
        h, slash, rest = r.partition("/")
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(slash + rest)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c)).otherwise(0.0))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.translate(text, char, ""))


def suffix(host_col: Column) -> Column:
    """The last label of the host and the letters that the third from the end begins with."""
    return F.concat_ws(".", F.regexp_extract(host_col, r"([a-z]*)[^.]*\.[^.]*\.[^.]*\z", 1), F.regexp_extract(host_col, r"([^.]*)\z", 1))


def lexical(df: DataFrame, url_col: str, prefix: str) -> DataFrame:
    """``df`` with the lexical features as columns ``prefix + name`` (null and odd urls count as empty text)."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    h, p = host(F.col(url_col)), path(F.col(url_col))
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    made = {
        "url_length": F.length(url),
        "host_length": F.length(h),
        "path_depth": _count(p, "/"),
        "host_labels": _count(h, "."),
        "digit_ratio": F.when(F.length(url) > 0, digits / F.length(url)).otherwise(0.0),
        "entropy": _entropy(url),
        "parameters": F.when(query == "", 0).otherwise(1 + _count(query, "&")),
        "hyphens": _count(h, "-"),
        "fragment": F.instr(url, "#") > 0,
    }
    return df.withColumns({prefix + k: v.cast("double") for k, v in made.items()} | {prefix + "suffix": suffix(h)})


class UrlModel:
    """``fit`` on (url, block 0/1); ``block_probability`` adds a column."""

    def __init__(self, model, suffixes: DataFrame | None, constant: float):
        self.model, self.suffixes, self.constant = model, suffixes, constant

    @classmethod
    def fit(cls, labelled: DataFrame, url_col: str = "url", label_col: str = "block") -> UrlModel:
        """Rows with a null url or label are left out; a url with several labels counts once with their mean, rounded
        up; with fewer than two classes the verdict is constant (none: allow)."""
        one = (
            labelled.select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{label_col}`").cast("double").alias("label"))
            .dropna()
            .groupBy("url")
            .agg(F.ceil(F.avg("label")).cast("double").alias("label"))
        )
        one = Stored(one.withColumn("suffix", suffix(host(F.col("url")))), "url-labels").df
        n = {float(r[0]): r[1] for r in one.groupBy("label").count().collect()}
        if len(n) < 2:
            return cls(None, None, next(iter(n), 0.0))
        rate = n[1.0] / sum(n.values())
        stats = one.groupBy("suffix").agg(F.count("*").cast("double").alias("suffix_rows"), F.sum("label").alias("suffix_blocks"))
        self = cls(None, Stored(stats, "url-suffixes").df, rate)
        sample = lexical(one.orderBy(F.xxhash64("url"), "url").limit(MAX_TRAIN).drop("suffix"), "url", "")
        train = self._vectors(sample, "", own=F.col("label")).select("url", "features", "label")
        train = train.coalesce(1).sortWithinPartitions("url").cache()  # one order, so reruns agree
        try:
            trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=20, seed=SEED)
            self.model = trees.fit(train)
            return self
        finally:
            train.unpersist()

    def _vectors(self, df: DataFrame, prefix: str, out: str = "features", own: Column | None = None) -> DataFrame:
        """``own``: the label of rows that are among those counted, each taken out of its own suffix's rate."""
        rows, blocks, key = (prefix + c for c in ("suffix_rows", "suffix_blocks", "suffix_key"))
        s = self.suffixes.select(F.col("suffix").alias(key), F.col("suffix_rows").alias(rows), F.col("suffix_blocks").alias(blocks))
        df = df.join(s, F.col(prefix + "suffix") == F.col(key), "left").drop(key).fillna({rows: 0.0, blocks: 0.0})
        if own is not None:
            df = df.withColumns({rows: F.col(rows) - 1, blocks: F.col(blocks) - own})
        df = df.withColumn(prefix + "suffix_block_rate", (F.col(blocks) + 20 * self.constant) / (F.col(rows) + 20))
        return VectorAssembler(inputCols=[prefix + c for c in FEATURES], outputCol=out).transform(df)

    def block_probability(self, df: DataFrame, url_col: str, out: str) -> DataFrame:
        if self.model is None:
            return df.withColumn(out, F.lit(self.constant))
        prefix = fresh(df, "lexical") + "_"
        vec, raw, prob, pred = (prefix + x for x in ("features", "raw", "probability", "prediction"))
        scored = self._vectors(lexical(df, url_col, prefix), prefix, vec)
        model = self.model.copy().setFeaturesCol(vec).setRawPredictionCol(raw).setProbabilityCol(prob).setPredictionCol(pred)
        scored = model.transform(scored).withColumn(out, vector_to_array(F.col(prob))[1])
        return scored.drop(*[c for c in scored.columns if c.startswith(prefix)])


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, block): a page's url names its document; block is 1 where that document is labelled low or toxic."""
    named = F.regexp_extract("url", r"\A[^:]*://[^/?#]*/[a-z]+/([0-9]{1,18})", 1)
    urls = pages.select("url", named.try_cast("bigint").alias("doc"))
    marks = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("block"))
    return urls.dropna().distinct().join(marks, F.col("doc") == F.col("doc_id")).select("url", "block")


def filter_urls(pages: DataFrame, model: UrlModel, *, url_col: str = "url", rules: Sequence[tuple[str, str]] = tuple(RULES), threshold: float = 0.5) -> DataFrame:
    """``pages`` plus ``host, path, rule, verdict, block_probability``.

    Null urls and urls without ``://`` have empty host and path, fit no rule and get the trees' verdict; repeated urls
    fare alike; an empty table stays empty. Columns of those names in ``pages`` are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "block_probability")
    scored = model.block_probability(pages, url_col, "block_probability")
    scored = scored.withColumn("host", host(F.col(url_col))).withColumn("path", path(F.col(url_col)))
    rule, say = rule_for(F.col("host"), F.col("path"), rules)
    by_trees = F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")
    return scored.withColumn("rule", rule).withColumn("verdict", F.coalesce(say, by_trees))
