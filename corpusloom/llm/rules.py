"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how accurate they are.

Statistics, votes and the posterior are DataFrame expressions. Documents meet the estimation only as counts of vote
patterns, of which there are at most 4 ** len(RULES). Two classes, good and bad; each rule has for each class its chances
to vote good, doubtful, bad or not at all; documents that fail the base rules are known to be bad. The posterior of a
document's votes, a product over the rules, replaces a filter that every rule must pass.

Defined results: a null text has no words; an empty or null text, one of fewer than 50 words and one that repeats
itself fail at once; a null id changes nothing; repeated rows are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common

SPACE = r"[\x20\x09-\x0D]+"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_bangs, n_stops, n_plain (words
    of letters, with a mark behind or not) and n_short (words of up to three letters) of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    split = first.select(
        "doc_id",
        F.array_remove(F.split("text", SPACE), "").alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count("text", F.lit(r"[A-ZÀ-ÖØ-Þ]")).alias("n_upper"),
        F.regexp_count("text", F.lit(r"!")).alias("n_bangs"),
        F.regexp_count("text", F.lit(r"[.,;:]")).alias("n_stops"),
    )
    # Each array is used twice or more in a step, so that no step is folded into the lambdas of the next.
    windows = split.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size(F.filter("w", lambda x: x.rlike(r"^\p{L}+[.,;:!?]?$"))).cast("long").alias("n_plain"),
        F.size(F.filter("w", lambda x: x.rlike(r"^\p{L}{1,3}$"))).cast("long").alias("n_short"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        *[F.col(c).cast("long").alias(c) for c in ("n_symbols", "n_upper", "n_bangs", "n_stops")],
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.slice(F.transform("w", lambda x, i: F.struct(F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))), 1, F.greatest(F.size("w") - 2, F.lit(0)))).alias("s"),
    )
    again = windows.select(
        *[c for c in windows.columns if c != "s"],
        F.sort_array(
            F.transform(
                F.filter("s", lambda x, k: x["h"].eqNullSafe(F.get("s", k - 1)["h"]) | x["h"].eqNullSafe(F.get("s", k + 1)["h"])),
                lambda x: x["i"],
            )
        ).alias("p"),
    )
    covered = F.aggregate(F.transform("p", lambda p, k: F.least(F.coalesce(F.get("p", k + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda a, b: a + b)
    return again.select(*[c for c in again.columns if c != "p"], covered.cast("long").alias("n_repeat_words"))


def _rate(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: What a rule may say of a document.
ABSTAINS, GOOD, DOUBTFUL, BAD = range(4)

#: (votes bad if, else doubtful if, else good if); else the rule abstains. What one statistic says is one vote of several
#: grades, and not several votes that repeat each other.
RULES = {
    "symbols": (lambda: _rate("n_symbols", "n_words") > 0.15, lambda: _rate("n_symbols", "n_words") > 0.06, lambda: _rate("n_symbols", "n_words") < 0.03),
    "capitals": (lambda: _rate("n_upper", "word_chars") > 0.4, lambda: _rate("n_upper", "word_chars") > 0.25, lambda: _rate("n_upper", "word_chars") < 0.15),
    "bangs": (lambda: _rate("n_bangs", "n_words") > 0.3, lambda: _rate("n_bangs", "n_words") > 0.1, lambda: _rate("n_bangs", "n_words") < 0.05),
    "repeats": (lambda: _rate("n_repeat_words", "n_words") > 0.3, lambda: _rate("n_repeat_words", "n_words") > 0.15, lambda: _rate("n_repeat_words", "n_words") < 0.1),
    "dup_lines": (lambda: (F.col("n_dup_lines") >= 3) & (_rate("n_dup_lines", "n_lines") > 0.3), lambda: F.col("n_dup_lines") > 0, lambda: F.col("n_dup_lines") == 0),
    "word_length": (
        lambda: (_rate("word_chars", "n_words") < 2.5) | (_rate("word_chars", "n_words") > 14),
        lambda: ~_rate("word_chars", "n_words").between(3, 10),
        lambda: _rate("word_chars", "n_words").between(3.5, 9),
    ),
    "plain_words": (lambda: _rate("n_plain", "n_words") < 0.6, lambda: _rate("n_plain", "n_words") < 0.8, lambda: _rate("n_plain", "n_words") > 0.9),
    "short_words": (lambda: _rate("n_short", "n_words") < 0.05, lambda: _rate("n_short", "n_words") < 0.1, lambda: _rate("n_short", "n_words") > 0.15),
    "stops": (lambda: _rate("n_stops", "n_words") < 0.005, lambda: ~_rate("n_stops", "n_words").between(0.015, 0.6), lambda: _rate("n_stops", "n_words").between(0.02, 0.5)),
}


def votes() -> list[Column]:
    """The vote of each rule, a column of its own."""
    return [F.when(bad(), BAD).when(doubtful(), DOUBTFUL).when(good(), GOOD).otherwise(ABSTAINS).alias(name) for name, (bad, doubtful, good) in RULES.items()]


#: Chances (abstains, good, doubtful, bad) that a rule is believed to have before the data, for bad and for good documents,
#: and the believed share of good ones. They weigh as BELIEF documents, however many are judged.
BELIEVED = {0: (0.2, 0.4, 0.2, 0.2), 1: (0.15, 0.8, 0.04, 0.01)}
BELIEVED_SHARE, BELIEF = 0.8, 50.0


def estimate(counts: dict[tuple[int, ...], tuple[float, float]], belief: float = BELIEF, rounds: int = 200) -> tuple[float, list[list[float]]]:
    """(log-odds of good before any vote, and for each rule what each of its votes adds), by expectation-maximisation.

    counts: for each pattern of votes how many documents have it that are judged, and how many that failed the base rules
    and are known to be bad. Two classes, good and bad; given the class, rules vote by themselves, and the posterior is the
    product of their chances. To begin with a document with one bad vote is undecided, one with more is bad."""
    n_rules = len(next(iter(counts), ()))
    first = {p: (0.95, 0.5, 0.05)[min(2, p.count(BAD))] for p in counts}
    good, prior, shifts = first, 0.0, [[0.0] * 4 for _ in range(n_rules)]
    for _ in range(rounds):
        free = sum(n for n, _ in counts.values())
        share = (sum(n * good[p] for p, (n, _) in counts.items()) + BELIEVED_SHARE * belief) / (free + belief)
        prior = math.log(share / (1 - share))
        for k in range(n_rules):
            seen = {y: [b * belief for b in BELIEVED[y]] for y in (0, 1)}
            for p, (n, known_bad) in counts.items():
                seen[1][p[k]] += n * good[p]
                seen[0][p[k]] += n * (1 - good[p]) + known_bad
            shifts[k] = [math.log(seen[1][v] / sum(seen[1])) - math.log(seen[0][v] / sum(seen[0])) for v in range(4)]
        new = {p: posterior(p, prior, shifts) for p in counts}
        moved = max((abs(new[p] - good[p]) for p in counts), default=0.0)
        good = new
        if moved < 1e-9:
            break
    return prior, shifts


def posterior(pattern: tuple[int, ...], prior: float, shifts: list[list[float]]) -> float:
    odds = prior + sum(shifts[k][v] for k, v in enumerate(pattern))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def judged(docs: DataFrame, threshold: float = 0.5, min_words: int = 50, max_repeated: float = 0.5, belief: float = BELIEF) -> DataFrame:
    """doc_id, the statistics, base_failed, p_good (posterior) and kept; docs needs doc_id and text."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > int(100 * max_repeated) * F.col("n_words"))
    stats = common.handed_over(statistics(docs).withColumn("base_failed", failed).select("*", *votes()), "rules")
    seen = stats.groupBy(*RULES).agg(F.count_if(~F.col("base_failed")).alias("free"), F.count_if("base_failed").alias("failed")).collect()  # 4 ** len(RULES) rows at most
    prior, shifts = estimate({tuple(r[name] for name in RULES): (r["free"], r["failed"]) for r in seen}, belief)
    odds = F.lit(prior)
    for name, shift in zip(RULES, shifts, strict=False):
        odds = odds + F.get(F.array(*map(F.lit, shift)), F.col(name))
    p_good = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds))))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", p_good.alias("p_good"), (~F.col("base_failed") & (p_good >= threshold)).alias("kept"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents"))
