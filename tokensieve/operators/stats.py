"""Lifetime and derived statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokensieve.options import DEFAULT, EngineOptions


def lifetime(info: DataFrame, since: Column | None = None, null_as_ham: bool = False) -> DataFrame:
    """Seven counters of (c, t, date_modified): c is h, s or u; t says whether it was trained as spam, null if it was not.

    null_as_ham counts messages that were never trained as trained ham.
    """
    rows = info if since is None else info.where(F.col("date_modified") >= since)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    c, t = F.col("c"), F.col("t")
    ham = F.coalesce(~t, F.lit(null_as_ham))
    spam = F.coalesce(t, F.lit(False))
    return rows.agg(
        n(c == "h").alias("num_ham"), n(c == "s").alias("num_spam"), n(c == "u").alias("num_unsure"),
        n(ham & (c == "u")).alias("num_trained_ham"), n(ham & (c == "s")).alias("num_trained_ham_fp"),
        n(spam & (c == "u")).alias("num_trained_spam"), n(spam & (c == "h")).alias("num_trained_spam_fn"),
    )


def derived(counters: DataFrame, o: EngineOptions = DEFAULT) -> DataFrame:
    """Counts, percentages and costs that follow from the seven counters; a share of nothing is null."""
    c = lambda n: F.col(n)
    d = counters.withColumn("num_seen", c("num_ham") + c("num_spam") + c("num_unsure"))
    d = d.withColumn("num_ham_correct", c("num_ham") - c("num_trained_spam_fn")).withColumn("num_spam_correct", c("num_spam") - c("num_trained_ham_fp"))
    d = d.withColumn("num_correct", c("num_ham_correct") + c("num_spam_correct")).withColumn("num_incorrect", c("num_trained_spam_fn") + c("num_trained_ham_fp"))
    d = d.withColumn("num_unsure_trained_ham", c("num_trained_ham") - c("num_trained_ham_fp")).withColumn("num_unsure_trained_spam", c("num_trained_spam") - c("num_trained_spam_fn"))
    d = d.withColumn("num_unsure_not_trained", c("num_unsure") - c("num_unsure_trained_ham") - c("num_unsure_trained_spam"))
    d = d.withColumn("total_ham", c("num_ham_correct") + c("num_trained_ham")).withColumn("total_spam", c("num_spam_correct") + c("num_trained_spam"))
    share = {
        "perc_ham": ("num_ham", "num_seen"), "perc_spam": ("num_spam", "num_seen"), "perc_unsure": ("num_unsure", "num_seen"),
        "perc_correct": ("num_correct", "num_seen"), "perc_incorrect": ("num_incorrect", "num_seen"), "perc_fp": ("num_trained_ham_fp", "num_seen"), "perc_fn": ("num_trained_spam_fn", "num_seen"),
        "perc_unsure_trained_ham": ("num_unsure_trained_ham", "num_unsure"), "perc_unsure_trained_spam": ("num_unsure_trained_spam", "num_unsure"), "perc_unsure_not_trained": ("num_unsure_not_trained", "num_unsure"),
        "perc_ham_incorrect": ("num_trained_ham_fp", "total_ham"), "perc_ham_unsure": ("num_unsure_trained_ham", "total_ham"),
        "perc_spam_correct": ("num_spam_correct", "total_spam"), "perc_spam_unsure": ("num_unsure_trained_spam", "total_spam"),
    }
    for name, (a, b) in share.items():
        d = d.withColumn(name, F.round(F.try_divide(100.0 * c(a), c(b)), 6))
    d = d.withColumn("total_cost", F.round(c("num_trained_ham_fp") * o.fp_weight + c("num_trained_spam_fn") * o.fn_weight + c("num_unsure") * o.unsure_weight, 6))
    return d.withColumn("cost_savings", F.round(c("num_spam") * o.fn_weight - c("total_cost"), 6))


def report(d: DataFrame) -> DataFrame:
    """The main lines of a text report."""
    f = lambda fmt, *cols: F.format_string(fmt, *cols)
    lines = F.array(
        f("Messages classified: %d", "num_seen"),
        f("Ham: %d (%.1f%%)", "num_ham", "perc_ham"),
        f("Spam: %d (%.1f%%)", "num_spam", "perc_spam"),
        f("Unsure: %d (%.1f%%)", "num_unsure", "perc_unsure"),
        f("False positives: %d", "num_trained_ham_fp"),
        f("False negatives: %d", "num_trained_spam_fn"),
        f("Total cost: $%.2f", "total_cost"),
    )
    return d.select(F.posexplode(lines).alias("line_no", "line"))
