"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every document gets a few shares (symbols, repeated lines, repeated three-word windows,
capitals). Of a rule's list of cutoffs, mild to strict, the strictest is used for which a
labelled holdout proves, stratum by stratum, that few good documents would be rejected: the exact
binomial tail P(X <= k | n, limit) of the k wrong rejections among n good documents must not exceed
the error level. The list is tested in order and ends at the first failure (a fixed sequence), so
only strata x rules share the error level (Bonferroni); the limit is shared among the rules, so
that it holds for their union. A stratum without enough labelled documents for a proof rejects
nothing but what the base rules reject.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywright.llm.common import col, fresh, stored, words

#: Base rule: fewer words, or a larger share (in percent) of words in repeated windows, always fail.
MIN_WORDS, MAX_REPEAT_PCT = 50, 50

#: Rule -> cutoffs, mild to strict. A document is rejected above a cutoff.
CUTOFFS = {
    "symbol_share": (0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01, 0.005),
    "dup_line_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "repeat_share": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "upper_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15),
}

#: At most this share of a stratum's good documents may be rejected, but for this chance.
MAX_FALSE_REJECTION, ERROR_LEVEL = 0.02, 0.05


def _repeated_words(tokens: Column) -> Column:
    """Words inside three-word windows that stand in the text twice or more.

    Windows are sorted with their places, equal neighbours are the repeated ones, and their places,
    sorted again, are added up without counting a word twice. `tokens` must be a stored column.
    """
    rest = lambda a, k: F.slice(a, k, F.greatest(F.size(a), F.lit(1)))
    windows = F.when(
        F.size(tokens) >= 3,
        F.arrays_zip(tokens.alias("w"), rest(tokens, 2).alias("x"), rest(tokens, 3).alias("y"), F.sequence(F.lit(0), F.size(tokens) - 1).alias("i")),
    )
    both = lambda a, b: F.when((a["y"] == b["y"]) & (a["x"] == b["x"]) & (a["w"] == b["w"]), F.array(a["i"], b["i"]))
    # The last two windows hold a null and equal nothing. A lambda variable is evaluated once, however often it is read.
    pairs = F.transform(F.array(F.sort_array(windows)), lambda s: F.filter(F.zip_with(s, rest(s, 2), both), lambda p: p.isNotNull()))
    repeated = F.array_distinct(F.flatten(F.get(pairs, F.lit(0))))
    total = F.aggregate(
        F.sort_array(repeated),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return F.coalesce(total, F.lit(0)).cast("long")


def rule_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` and one struct column `rule_stats`: the counts of each whole text and the rules' shares.

    Null texts count as empty; empty texts have counts and shares of 0.
    """
    out, text = fresh(docs, "rule_stats"), F.coalesce(col(text_col), F.lit(""))
    w, ln = fresh(docs, "__words"), fresh(docs, "__lines")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(*map(col, keep), text.alias("__text"), words(col(text_col)).alias(w), lines.alias(ln))
    counted = base.select(
        *map(col, keep),
        F.size(w).cast("long").alias("__n"),
        F.length(F.array_join(w, "")).cast("long").alias("__chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("__symbols"),
        F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long").alias("__upper"),
        F.size(ln).cast("long").alias("__lines_n"),
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("__dup"),
        _repeated_words(F.col(w)).alias("__repeat"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)).cast("double"), F.lit(0.0))
    n = F.col("__n")
    return counted.select(
        *map(col, keep),
        F.struct(
            n.alias("n_words"),
            F.col("__chars").alias("word_chars"),
            F.col("__symbols").alias("n_symbols"),
            F.col("__dup").alias("n_dup_lines"),
            F.col("__repeat").alias("n_repeat_words"),
            ((n < MIN_WORDS) | (100 * F.col("__repeat") > MAX_REPEAT_PCT * n)).alias("base_failed"),
            share("__symbols", "__chars").alias("symbol_share"),
            share("__dup", "__lines_n").alias("dup_line_share"),
            share("__repeat", "__n").alias("repeat_share"),
            share("__upper", "__chars").alias("upper_share"),
        ).alias(out),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial (n, p), exact up to rounding: log terms added one by one.

    From the mean upwards the tail is above any error level in use; 1 stands for it there.
    """
    odds = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))
    total = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("term"), first.alias("sum")),
        lambda a, i: F.transform(
            F.array(a["term"] + F.log((n - i + 1) / i) + F.lit(odds)),
            lambda t: F.struct(t.alias("term"), (F.greatest(a["sum"], t) + F.log1p(F.exp(-F.abs(a["sum"] - t)))).alias("sum")),
        )[0],
        lambda a: F.exp(a["sum"]),
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def safe_cutoffs(
    stats: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    stats_col: str = "rule_stats",
    max_false_rejection: float = MAX_FALSE_REJECTION,
    error_level: float = ERROR_LEVEL,
) -> DataFrame:
    """(stratum, one cutoff column a rule): the strictest proven cutoff, null where none is.

    `stats` needs doc_id, the stratum and the stats; `labels` doc_id and quality. A document counts
    as good if some label of its id says 1. Only strata with at least one proven cutoff come out;
    a proof takes over log(error)/log(1 - limit) good documents, so the table has at most
    (labelled documents) / 1,000 rows or so, and it is joined by broadcast for that reason.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    held = stats.select("doc_id", col(stratum).alias("__stratum"), F.col(stats_col).alias("s")).join(good, "doc_id", "left_semi")
    counts = held.groupBy("__stratum").agg(
        F.count("*").alias("n"),
        *[F.sum((F.col(f"s.{rule}") > cut).cast("long")).alias(f"{rule}__{i}") for rule, cuts in CUTOFFS.items() for i, cut in enumerate(cuts)],
    )
    # Counted before the cutoffs unfold: strata, not tests.
    tests = counts.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(0)))).select(
        "__stratum",
        "n",
        "strata",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(float(cut)).alias("cut"), F.col(f"{rule}__{i}").alias("k"))
                    for rule, cuts in CUTOFFS.items()
                    for i, cut in enumerate(cuts)
                ]
            )
        ),
    )
    limit = max_false_rejection / len(CUTOFFS)
    passes = binomial_tail(F.col("k"), F.col("n"), limit) <= F.lit(error_level / len(CUTOFFS)) / F.col("strata")
    run = Window.partitionBy("__stratum", "rule").orderBy("step")
    proven = tests.withColumn("pass", passes).withColumn("all_pass", F.min("pass").over(run)).where("all_pass")
    return proven.groupBy("__stratum").agg(*[F.min(F.when(F.col("rule") == rule, F.col("cut"))).alias(f"cut_{rule}") for rule in CUTOFFS])


def with_verdict(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang", stats_col: str = "rule_stats", out: str = "kept") -> DataFrame:
    """The rows with `out`: false if the base rules fail or some share is above its stratum's cutoff."""
    joined = stats.join(F.broadcast(cutoffs), col(stratum).eqNullSafe(F.col("__stratum")), "left")
    above = [F.coalesce(F.col(f"{stats_col}.{rule}") > F.col(f"cut_{rule}"), F.lit(False)) for rule in CUTOFFS]
    rejected = F.col(f"{stats_col}.base_failed")
    for rule in above:
        rejected = rejected | rule
    return joined.withColumn(out, ~rejected).drop("__stratum", *[f"cut_{rule}" for rule in CUTOFFS])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts of every document and its verdict `kept`.

    Repeated rows are judged one by one alike; a null lang is a stratum of its own; with empty
    labels only the base rules reject.
    """
    stats = stored(rule_stats(docs.select("doc_id", "lang", "text"), ["doc_id", "lang"]), "rule-stats")
    judged = with_verdict(stats, safe_cutoffs(stats, labels))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged.select("doc_id", *[F.col(f"rule_stats.{c}").alias(c) for c in names], "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, all their columns unchanged."""
    plain = docs.select(F.struct(*map(col, docs.columns)).alias("__row"), col("doc_id"), col("lang"), col("text"))
    scored = stored(rule_stats(plain, ["doc_id", "lang", "__row"]), "rule-docs")
    return with_verdict(scored, safe_cutoffs(scored, labels)).where("kept").select("__row.*")
