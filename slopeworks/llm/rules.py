"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule rejects a text whose statistic is above a cutoff. The cutoffs come from labelled
good texts, per stratum: the strictest one for which the exact binomial bound still
guarantees, all rules and strata together, that at most ``ALPHA`` of the good texts are
rejected with confidence ``1 - DELTA``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopeworks.llm.common import WORD, held_out, materialise, one_label

#: Words in a window whose repetition counts.
WINDOW = 8
#: Good texts that all rules together may reject, and the chance that a bound fails.
ALPHA, DELTA = 0.02, 0.05
#: Rules: a statistic in thousandths, and the strictest cutoff that is tried for it.
RULES = {"symbols": 30, "repeats": 120, "lines": 150}


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def _repeated_words(words: Column) -> Column:
    """Words covered by windows whose content occurs at least twice in the text.

    Windows are told apart by a 64-bit hash. Sorting (hash, start) puts equal windows side by
    side; most texts have none and stop at the distinct count.
    """
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    windows = F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]))

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = _let(
            pairs,
            lambda p: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(p, lambda x, k: F.struct(x["i"].alias("i"), ((F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])).alias("twice"))),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        # The union of the windows: each adds what the window before it has not covered.
        begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n"), s.alias("last"))
        return F.aggregate(starts, begin, step)["n"]

    counted = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))
    return F.when(F.size(words) > WINDOW, counted).otherwise(F.lit(0).cast("long"))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the rules' statistics."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    per_text = lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeated_words(w).alias("repeated")
    )
    counted = F.struct(
        _let(words, per_text).alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )
    per_mille = lambda part, whole: F.floor(1000 * part / F.greatest(whole, F.lit(1))).cast("int")
    return (
        docs.withColumn("_c", counted)
        .withColumns({
            "n_words": F.col("_c.w.n"), "word_chars": F.col("_c.w.chars"), "n_symbols": F.col("_c.n_symbols"),
            "n_dup_lines": F.col("_c.l.dup"), "n_repeat_words": F.col("_c.w.repeated"), "_lines": F.col("_c.l.n"),
        })
        .drop("_c")
        .withColumns({
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "_symbols": per_mille(F.col("n_symbols"), F.col("word_chars")),
            "_repeats": per_mille(F.col("n_repeat_words"), F.col("n_words")),
            "_lines": per_mille(F.col("n_dup_lines"), F.col("_lines")),
        })
    )


def _allowed(n: Column, alpha: float, delta: Column) -> Column:
    """The most rejections among n good texts whose exact binomial upper bound is at most alpha; -1 if none.

    Clopper-Pearson: the bound for k is at most alpha just when P(X <= k) <= delta for
    X ~ Bin(n, alpha). Terms are summed from their logarithms, from k = 0 on.
    """
    import math

    odds, none = math.log(alpha / (1 - alpha)), math.log(1 - alpha)
    begin = F.struct((n * F.lit(none)).alias("log"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"))

    def step(a: Column, k: Column) -> Column:
        log = F.when(k == 0, a["log"]).otherwise(a["log"] + F.log((n - k + 1) / F.greatest(k, F.lit(1))) + odds)
        total = a["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.when(total <= delta, k).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * alpha).cast("long")), begin, step)["k"]


def cutoffs(scored: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) from good texts (label 1, base passed, label open to learning); no row where no cutoff is safe.

    Bonferroni: with R rules and G groups every bound is taken at alpha / R and delta / (R * G). A
    group is a stratum whose good texts would do at G = S, the number of strata; all others
    share one, so G is S at most. Their bound holds for their good texts together.
    """
    good = (
        scored.where("not base_failed").where(~held_out(F.col("doc_id")))
        .join(one_label(labels, "quality").where("label = 1"), "doc_id")
        .select(F.col(stratum).alias("stratum"), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"_{r}").alias("q")) for r in RULES])).alias("x"))
        .groupBy("stratum", "x.rule", "x.q").agg(F.count("*").alias("n"))
    )
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_rule = alpha / len(RULES)
    # A bounded table from here on: strata x rules x distinct thousandths.
    strata = good.groupBy("stratum").agg((F.sum("n") / len(RULES)).cast("long").alias("good")).withColumn("tests", F.count("*").over(everything) * len(RULES))
    strata = strata.withColumn("thin", _allowed(F.col("good"), per_rule, F.lit(delta) / F.col("tests")) < 0).withColumn("own", F.when(~F.col("thin"), F.col("stratum")))
    tests = (F.sum((~F.col("thin")).cast("long")).over(everything) + F.max(F.col("thin").cast("long")).over(everything)) * len(RULES)
    strata = strata.withColumns({"tests": tests, "good": F.sum("good").over(Window.partitionBy("thin", "own"))})
    strata = strata.withColumn("allowed", _allowed(F.col("good"), per_rule, F.lit(delta) / F.col("tests"))).withColumnRenamed("stratum", "_s")
    group = Window.partitionBy("thin", "own", "rule")
    above = F.coalesce(F.sum("n").over(group.orderBy(F.col("q").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    strictest = F.create_map(*[F.lit(x) for r in RULES.items() for x in r])
    found = (
        good.join(strata, F.col("stratum").eqNullSafe(F.col("_s")))
        .groupBy("thin", "own", "rule", "q").agg(F.sum("n").alias("n"), F.max("allowed").alias("allowed"))
        .withColumn("above", above)
        .where("above <= allowed")
        .groupBy("thin", "own", "rule").agg(F.min("q").alias("q"))
        .select(F.col("thin").alias("_thin"), F.col("own").alias("_own"), "rule", F.greatest("q", strictest[F.col("rule")]).alias("cutoff"))
    )
    return strata.join(found, (F.col("thin") == F.col("_thin")) & F.col("own").eqNullSafe(F.col("_own"))).select(F.col("_s").alias("stratum"), "rule", "cutoff")


def keep_passing(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that base and rules keep, all columns as they were, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    judged = apply_rules(docs.select(row, "doc_id", "text", stratum), labels, stratum, keep_text=False)
    return judged.where("kept").select("row.*")


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", keep_text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, the stratum's column and others) with the statistics and ``kept``; columns of these names are replaced.

    Null and empty texts have no words and fail the base; a null stratum is a stratum; a
    stratum with too few good texts to certify a cutoff shares one with the others like it; if
    they are too few together, or a stratum has none, all that pass the base are kept; equal
    rows are judged alike; no rows give no rows.
    """
    scored = with_statistics(docs)
    scored = materialise(scored if keep_text else scored.drop("text"), "rules-statistics")
    found = cutoffs(scored, labels, stratum).groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES])
    found = materialise(found, "rules-cutoffs")  # a row per stratum
    over = [F.coalesce(F.col(f"_{r}") > F.col(f"_cut_{r}"), F.lit(False)) for r in RULES]
    verdict = ~over[0]
    for x in over[1:]:
        verdict &= ~x
    judged = scored.join(found.withColumnRenamed("stratum", "_stratum"), F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & verdict).drop("_stratum", *[f"_{x}{r}" for r in RULES for x in ("", "cut_")])
