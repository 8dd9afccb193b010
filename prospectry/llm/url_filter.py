"""URL filters: rules first, then gradient-boosted trees on lexical features, in DataFrame operations only.

The urls that a rule decides are the labelled ones. From a bounded sample of them Spark ML's boosted trees
learn what blocked urls look like; urls without a rule get the trees' verdict. Features are numbers computed
from the url text: lengths, depth, shares of digits and other signs, entropy of the letters, parameters, and
how often urls with the same host suffix, or the same first path part, were blocked. Those shares come from all
labelled urls; while training, a url's share leaves out the part of the table (fold) that the url itself is in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectry.session import materialize

#: (rule, blocked): host part up to the first slash, path part from there.
RULES = [("com/", False), ("example.com/en/", True), ("www.example.com/en/", False), ("net/es/", True), ("net/fr/", True)]
#: Bound of the training sample, in labelled urls; trees, their depth, and folds of the suffix statistics.
SAMPLE, TREES, DEPTH, FOLDS = 20_000, 20, 4, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBERS = [
    "length", "host_length", "path_length", "depth", "labels", "digits", "digit_ratio", "hyphens", "entropy", "host_entropy", "params",
    "query_length", "fragment", "secure", "longest_part", "last_is_number", "extension", "suffix_rate", "domain_rate", "part_rate",
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The longest rule that fits (of equally long ones the first in the list), or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per letter of the text's letter frequencies."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(letters)
    counts = F.transform(F.array_distinct(letters), lambda c: F.size(letters) - F.size(F.array_remove(letters, c)))
    return F.when(n == 0, F.lit(0.0)).otherwise(
        F.aggregate(counts, F.lit(0.0), lambda acc, k: acc - (k / n) * F.log2(k / n))
    )


def features(df: DataFrame, url_column: str) -> DataFrame:
    """``df`` with host, path and the lexical features of the url."""
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    named = df.withColumn("_url", url).withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    text, host, path = F.col("_url"), F.col("host"), F.col("path")
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))
    labels = F.split(host, r"\.")
    return named.select(
        "*",
        F.length(text).alias("length"), F.length(host).alias("host_length"), F.length(path).alias("path_length"),
        F.size(parts).alias("depth"), F.size(labels).alias("labels"), digits.alias("digits"),
        (digits / F.greatest(F.length(text), F.lit(1))).alias("digit_ratio"), (F.length(text) - F.length(F.replace(text, F.lit("-")))).alias("hyphens"),
        _entropy(text).alias("entropy"), _entropy(host).alias("host_entropy"),
        F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).alias("params"), F.length(query).alias("query_length"),
        F.contains(text, F.lit("#")).cast("int").alias("fragment"), F.startswith(text, F.lit("https://")).cast("int").alias("secure"),
        F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)).alias("longest_part"), last.rlike(r"^[0-9]+$").cast("int").alias("last_is_number"),
        last.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int").alias("extension"),
        F.substring_index(host, ".", -1).alias("_suffix"), F.substring_index(host, ".", -2).alias("_domain"), F.coalesce(F.get(parts, 0), F.lit("")).alias("_part"),
    )


def _rates(labelled: DataFrame, key: str) -> DataFrame:
    """(key, fold, n, blocked) of the labelled urls."""
    return labelled.groupBy(key, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))


def _with_rates(df: DataFrame, tables: dict[str, DataFrame], base: float, without_own: bool) -> DataFrame:
    """Join the smoothed block rate of each key; ``without_own`` leaves out the row's own fold."""
    for key, folds in tables.items():
        per_key = folds.groupBy(key).agg(
            F.sum("n").alias("_n"), F.sum("bad").alias("_bad"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "bad")))).alias("_of")
        )
        df = df.join(per_key, key, "left")
        n, bad = F.coalesce("_n", F.lit(0)), F.coalesce("_bad", F.lit(0))
        if without_own:
            own = F.try_element_at("_of", F.col("fold"))
            n, bad = n - F.coalesce(own["n"], F.lit(0)), bad - F.coalesce(own["bad"], F.lit(0))
        df = df.withColumn(key.removeprefix("_") + "_rate", (bad + 10 * base) / (n + 10)).drop("_n", "_bad", "_of")
    return df


def judge(
    df: DataFrame, id_column: str = "page_id", url_column: str = "url", rules: list[tuple[str, bool]] = RULES, sample: int = SAMPLE,
    seed: int = 5,
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict (allow or block), score (null where a rule decides).

    A url gets the longest rule's verdict, or else the trees'. Null urls and urls without ``://`` have an empty host
    and path, fit no rule and are judged by their features. If the labelled urls are all of one kind, or none
    exist, urls without a rule are allowed. Repeated rows are judged alike; further columns are ignored.
    """
    blocked = reduce(lambda acc, r: F.when(F.col("rule") == r[0], F.lit(int(r[1]))).otherwise(acc), rules, F.lit(None).cast("int"))
    rows = features(df.select(F.col(id_column), F.col(url_column).cast("string").alias("_in")), "_in")
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("label", blocked)
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("_url"), F.lit(FOLDS)).cast("int"))
    labelled = rows.filter("label IS NOT NULL")
    n, bad = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    result = [id_column, "host", "path", "rule"]
    if not 0 < bad < n:
        return rows.select(*result, F.when(F.col("label") == 1, "block").otherwise("allow").alias("verdict"), F.lit(None).cast("double").alias("score"))
    tables = {key: materialize(_rates(labelled, key), "url-rates") for key in ("_suffix", "_domain", "_part")}
    chosen = labelled.orderBy(F.xxhash64("_url", F.lit(seed)), id_column).limit(sample)
    assemble = VectorAssembler(inputCols=NUMBERS, outputCol="features")
    training = materialize(_with_rates(chosen, tables, bad / n, True).select(F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in NUMBERS]), "url-sample")
    trees: GBTClassificationModel = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=seed, cacheNodeIds=False).fit(assemble.transform(training))
    scored = trees.transform(assemble.transform(_with_rates(rows, tables, bad / n, False)))
    score = vector_to_array("probability")[1]
    by_trees = F.when(score >= 0.5, "block").otherwise("allow")
    return scored.select(
        *result, F.when(F.col("label").isNull(), by_trees).when(F.col("label") == 1, "block").otherwise("allow").alias("verdict"),
        F.when(F.col("label").isNull(), score).alias("score"),
    )
