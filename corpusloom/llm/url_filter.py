"""URL filters: rules first, else logistic regression on hashed character n-grams of host and path.

Training and scoring are DataFrame expressions only. The labelled table is small by contract (`most_labelled` rows at
most) and is folded over as one array: each example moves the weights against its error, ever less, for a fixed number of rounds.

Defined results: a null url or one without `://` has an empty host and path, fits no rule and gets the verdict of the
bias alone; long urls take time in proportion; repeated rows are judged each; an empty table gives no rows; other
columns are ignored. Longer rules win; of equally long ones the one given first.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: The small labelled table that comes with the library: url and label (1: block); none of its hosts is in a judged table.
LABELLED = Path(__file__).with_name("labelled_urls.csv")

BUCKETS = 1024  # for the host, and as many for the path
PATH_WEIGHT = 0.3


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(letters: str, first: int) -> Column:
    """Hashed 3- and 4-grams of an array of characters, in BUCKETS places from `first`."""
    c = F.col(letters)
    three = F.transform(c, lambda x, i: F.xxhash64(x, F.get(c, i + 1), F.get(c, i + 2)))
    four = F.transform(c, lambda x, i: F.xxhash64(x, F.get(c, i + 1), F.get(c, i + 2), F.get(c, i + 3)))
    return F.transform(F.concat(three, four), lambda h: (F.pmod(h, F.lit(BUCKETS)) + first).cast("int"))


def _features(df: DataFrame) -> DataFrame:
    """Adds `host_grams` and `path_grams` to host and path; ^ and $ mark the ends, and the digits of a path are one digit."""
    marked = df.withColumn("host_c", F.split(F.concat(F.lit("^"), "host", F.lit("$")), "")).withColumn("path_c", F.split(F.concat(F.lit("^"), F.translate("path", "123456789", "000000000"), F.lit("$")), ""))
    return marked.withColumn("host_grams", _grams("host_c", 0)).withColumn("path_grams", _grams("path_c", BUCKETS)).drop("host_c", "path_c")


def trained(labelled: DataFrame, rounds: int = 20, rate: float = 60.0, decay: float = 3e-4, most_labelled: int = 5000) -> list[float]:
    """Weights of the buckets, then the bias, from url and label (1: block)."""
    usable = labelled.filter("url IS NOT NULL AND label IS NOT NULL")
    if usable.limit(most_labelled + 1).count() > most_labelled:
        raise ValueError(f"the labelled table is meant to be small: {most_labelled} rows at most")
    host, path = host_and_path(F.col("url"))
    grams = _features(usable.select("url", "label", host.alias("host"), path.alias("path")))
    counted = F.expr(
        f"""transform(sequence(0, {2 * BUCKETS - 1}), d -> CASE WHEN d < {BUCKETS}
            THEN size(filter(host_grams, g -> g = d)) / size(host_grams) ELSE {PATH_WEIGHT}D * size(filter(path_grams, g -> g = d)) / size(path_grams) END)"""
    )
    rows = grams.select(F.xxhash64("url").alias("o"), F.col("label").cast("double").alias("y"), F.concat(counted, F.array(F.lit(0.2).cast("double"))).alias("x"))
    examples = rows.agg(F.sort_array(F.collect_list(F.struct("o", "y", "x"))).alias("e"))

    def step(w: Column, e: Column) -> Column:
        rate = e["r"]
        p = 1 / (1 + F.exp(-F.aggregate(F.zip_with(w, e["x"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))
        return F.element_at(F.transform(F.array(rate * (e["y"] - p)), lambda g: F.zip_with(w, e["x"], lambda a, b: a * (1 - decay) + g * b)), 1)

    steps = F.transform(F.flatten(F.array_repeat("e", rounds)), lambda e, i: F.struct(e["y"].alias("y"), e["x"].alias("x"), (rate / (1 + i / F.size("e"))).alias("r")))
    fitted = examples.select(F.aggregate(steps, F.expr(f"array_repeat(0.0D, {2 * BUCKETS + 1})"), step).alias("w")).head()
    return list(fitted["w"])


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; a rule fits its host and all subdomains, where the path starts as its own."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(reversed(rules), key=lambda r: len(r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, weights: list[float], rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score; pages needs page_id and url."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    w = F.expr("array(" + ",".join(f"{x!r}D" for x in weights[:-1]) + ")")

    def mean(grams: str) -> Column:
        return F.aggregate(F.transform(grams, lambda g: F.get(w, g)), F.lit(0.0), lambda s, v: s + v) / F.size(grams)

    scored = _features(parts).select("page_id", "host", "path", (1 / (1 + F.exp(-(mean("host_grams") + PATH_WEIGHT * mean("path_grams") + 0.2 * weights[-1])))).alias("block_score"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "block_score")


def labelled_urls(spark: SparkSession, path: str | Path = LABELLED) -> DataFrame:
    """url and label of a small csv file on the driver; other labelled tables go to `trained` as they are."""
    with open(path, encoding="utf-8") as f:
        rows = [(r["url"], int(r["label"])) for r in csv.DictReader(f)]
    return spark.createDataFrame(rows, "url string, label int")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "pages"), trained(labelled_urls(spark)))
