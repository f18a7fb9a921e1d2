"""Quality rules whose cutoffs bound the share of good documents they reject, per stratum, with exact binomial tests.

Every rule compares one figure of a text with a cutoff from a fixed grid. On labelled holdouts of a stratum, a cutoff is
certified if rejecting as few good documents as it does would be unlikely for a cutoff that rejects more than the allowed
share: P(Bin(n, risk / rules) <= k) <= error / (strata * rules). Both divisions are Bonferroni corrections; the cutoffs of a
rule are tested in a fixed order, from the most lenient until one fails, which needs no further one. So with probability
1 - error no stratum loses more than ``risk`` of its good documents to all rules together. The last certified cutoff of a
rule is used; where none is, the rule rejects nothing. Everything is built-in SQL, inside each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.operators.joins import broadcast_if_small
from webcorpus.session import written

# Separators of words, symbols, and the limits of the base rules.
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"  # also as the inside of a class
LEAST_WORDS = 50
CAPITALS = "A-Z"

# Rules: a figure, and the grid of its cutoffs. A document is rejected if the figure is above the cutoff.
# The grids begin where a reader would begin to doubt: lower cutoffs are never tested.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0)),
    "repeats": ("n_repeat_words / n_words", (0.15, 0.2, 0.3, 0.4, 0.5)),
    "dup_lines": ("n_dup_lines / n_lines", (0.2, 0.3, 0.4, 0.5, 0.75)),
    "capitals": ("n_capitals / word_chars", (0.2, 0.3, 0.5, 0.75)),
    "long_words": ("word_chars / n_words", (8.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0)),
}


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once; pasted into lambdas it would be worked out for every element."""
    return F.transform(F.array(value), use)[0]


def _count(text: Column, chars: str) -> Column:
    """How many of ``chars``, the inside of a class, a text has."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("bigint")


def _repeat_words(words: Column) -> Column:
    """Places covered by windows of three words that occur twice or more, in one sort of the windows."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            found = F.filter(s, lambda x, k: same(x, k + 1) | same(x, k - 1))
            return _let(
                F.sort_array(F.transform(found, lambda x: x["i"])),
                lambda p: F.aggregate(
                    F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - at, F.lit(3)))),
                    F.lit(0), lambda total, n: total + n,
                ),
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(ordered, places))

    return F.when(F.size(words) < 4, 0).otherwise(_let(windows, covered)).cast("bigint")


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Figures of each text; a null text has no words and all of them are zero."""
    whole = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].cast("bigint").alias("doc_id"), docs[stratum].cast("string").alias("stratum"), whole.alias("text"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    by_word = _let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"),
                                           F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                                           _repeat_words(w).alias("n_repeat_words")))
    by_line = _let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"),
                                             (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    return rows.select(
        "doc_id", "stratum", by_word.alias("w"), by_line.alias("l"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"), _count(F.col("text"), CAPITALS).alias("n_capitals"),
    ).select("doc_id", "stratum", "w.*", "l.*", "n_symbols", "n_capitals")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def figure(rule: str) -> Column:
    """A rule's figure, null (never above a cutoff) where its denominator is zero."""
    above, below = RULES[rule][0].split(" / ")
    return F.col(above) / F.nullif(F.col(below), F.lit(0))


def at_most(n: Column, k: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), summed in logarithms; one where k is above the mean, which no test would certify."""
    first = n * F.log1p(F.lit(-rate))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((n - j + 1) / j) + F.log(F.lit(rate / (1 - rate)))
        high, low = F.greatest(s["total"], term), F.least(s["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    total = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("term"), first.alias("total")), step, lambda s: F.exp(s["total"]),
    )
    return F.when(k > n * rate, F.lit(1.0)).otherwise(total)


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float, error: float, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``stratum`` and a column per rule: its last certified cutoff, or null.

    Good documents are those labelled 1 that pass the base rules. One aggregation counts them and all their rejections.
    """
    known = labels.groupBy(labels[key].cast("bigint").alias("doc_id")).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    good = rows.where(~base_failed()).join(known.where("low = 1 AND high = 1").select("doc_id"), "doc_id", "left_semi")
    sums = [
        F.count_if(figure(rule) > cut).alias(f"{rule}_{i}") for rule, (_, grid) in RULES.items() for i, cut in enumerate(grid)
    ]
    counted = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums)
    counted = counted.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy()))  # a row per stratum
    level = F.lit(error / len(RULES)) / F.col("strata")
    out = []
    for rule, (_, grid) in RULES.items():
        so_far, safe = F.lit(True), []
        for i, cut in reversed(list(enumerate(grid))):
            so_far = so_far & (at_most(F.col("n"), F.col(f"{rule}_{i}"), risk / len(RULES)) <= level)
            safe.append(F.when(so_far, cut))
        out.append(F.least(*safe).alias(f"cut_{rule}"))
    return counted.select("stratum", *out)


def quality_rules(
    docs: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05, key: str = "doc_id", text: str = "text",
    stratum: str = "lang",
) -> DataFrame:
    """``doc_id, stratum``, the figures, ``base_failed`` and ``kept`` per row of ``docs``.

    ``kept`` is false if a base rule fails or a figure is above its stratum's cutoff. Strata without enough labelled good
    documents, among them a null stratum without any, have no cutoffs and only the base rules. Null and empty texts have no
    words and fail. Repeated rows stay rows; labels that conflict, are null or have no document count for nothing. Other
    columns aren't read. An empty table gives an empty result.
    """
    rows = written(features(docs, key, text, stratum), "rule-figures")
    found = written(cutoffs(rows, labels, risk, error), "rule-cutoffs").withColumnRenamed("stratum", "_stratum")
    met = rows.join(broadcast_if_small(found), F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    above = [F.coalesce(figure(rule) > F.col(f"cut_{rule}"), F.lit(False)) for rule in RULES]
    rejected = above[0]
    for one in above[1:]:
        rejected = rejected | one
    failed = F.coalesce(base_failed(), F.lit(True))
    return met.select(*rows.columns, failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))
