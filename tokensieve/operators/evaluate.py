"""Cross-validation, confusion, histograms, cutoffs, costs and comparisons.

Scores are (msg_id, is_spam, fold, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokensieve.operators.model import exploded, probability
from tokensieve.operators.score import clues, score
from tokensieve.options import DEFAULT, EngineOptions

#: Places to which cross-validated scores are rounded before they are counted.
PLACES = 6


def _n(flag: Column) -> Column:
    return F.coalesce(F.sum(F.when(flag, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def fold_models(messages: DataFrame, how: str = "subtract") -> DataFrame:
    """token, fold, spamcount, hamcount, nspam, nham: for each fold the model of all others.

    ``subtract`` takes a fold's counts from the totals; ``scratch`` counts the other folds anew. Tokens
    that only the fold itself holds have no row.
    """
    spam = F.col("is_spam")
    per = exploded(messages, "fold", "is_spam").groupBy("token", "fold").agg(_n(spam).alias("s"), _n(~spam).alias("h"))
    size = messages.groupBy("fold").agg(_n(spam).alias("ns"), _n(~spam).alias("nh"))
    folds = size.select("fold")
    if how == "subtract":
        total = per.groupBy("token").agg(F.sum("s").alias("ts"), F.sum("h").alias("th"))
        rows = total.crossJoin(F.broadcast(folds)).join(per, ["token", "fold"], "left")
        info = rows.select("token", "fold", (F.col("ts") - F.coalesce("s", F.lit(0))).alias("spamcount"), (F.col("th") - F.coalesce("h", F.lit(0))).alias("hamcount"))
        all_ = size.agg(F.sum("ns").alias("ts"), F.sum("nh").alias("th"))
        meta = size.crossJoin(F.broadcast(all_)).select("fold", (F.col("ts") - F.col("ns")).alias("nspam"), (F.col("th") - F.col("nh")).alias("nham"))
    else:
        other = folds.select(F.col("fold").alias("f"))
        info = per.join(F.broadcast(other), F.col("fold") != F.col("f")).groupBy("token", F.col("f").alias("fold2")).agg(F.sum("s").alias("spamcount"), F.sum("h").alias("hamcount")).withColumnRenamed("fold2", "fold")
        meta = size.join(F.broadcast(other), F.col("fold") != F.col("f")).groupBy(F.col("f").alias("fold2")).agg(F.sum("ns").alias("nspam"), F.sum("nh").alias("nham")).withColumnRenamed("fold2", "fold")
    return info.where("spamcount > 0 OR hamcount > 0").join(F.broadcast(meta), "fold")


def _score_folds(messages: DataFrame, models: DataFrame, by: list[str], o: EngineOptions) -> DataFrame:
    probs = models.select("token", *[c for c in by if c in models.columns], probability(F.col("spamcount"), F.col("hamcount"), F.col("nspam"), F.col("nham"), o).alias("prob"))
    found = clues(exploded(messages, *by), probs, o, by)
    out = score(messages.select("msg_id", "is_spam", *[c for c in by if c != "msg_id"]), found, by)
    return out.withColumn("score", F.round("score", PLACES))


def cross_validate(messages: DataFrame, how: str = "subtract", o: EngineOptions = DEFAULT) -> DataFrame:
    """msg_id, is_spam, fold, score: each message of (msg_id, is_spam, fold, tokens) scored by the other folds' model, all folds at once."""
    return _score_folds(messages, fold_models(messages, how), ["msg_id", "fold"], o).select("msg_id", "is_spam", "fold", "score")


def grid(messages: DataFrame, o: EngineOptions = DEFAULT) -> DataFrame:
    """train_fold, test_fold, msg_id, is_spam, score for every two different folds."""
    spam = F.col("is_spam")
    per = exploded(messages, "fold", "is_spam").groupBy("token", "fold").agg(_n(spam).alias("spamcount"), _n(~spam).alias("hamcount"))
    size = messages.groupBy("fold").agg(_n(spam).alias("nspam"), _n(~spam).alias("nham"))
    models = per.join(F.broadcast(size), "fold").withColumnRenamed("fold", "train_fold")
    folds = size.select(F.col("fold").alias("train_fold"))
    pairs = messages.join(F.broadcast(folds), F.col("fold") != F.col("train_fold"))
    out = _score_folds(pairs, models, ["msg_id", "train_fold", "fold"], o)
    return out.select("train_fold", F.col("fold").alias("test_fold"), "msg_id", "is_spam", "score")


def confusion(scores: DataFrame, by: list[str], o: EngineOptions = DEFAULT) -> DataFrame:
    """Right, wrong and unsure counts of both classes."""
    ham, spam = F.col("score") < o.ham_cutoff, F.col("score") >= o.spam_cutoff
    own = {"ham": ~F.col("is_spam"), "spam": F.col("is_spam")}
    right, wrong = {"ham": ham, "spam": spam}, {"ham": spam, "spam": ham}
    aggs = [_n(own[k]).alias(f"n{k}") for k in own]
    for k in own:
        aggs += [_n(own[k] & right[k]).alias(f"{k}_right"), _n(own[k] & wrong[k]).alias(f"{k}_wrong"), _n(own[k] & ~ham & ~spam).alias(f"{k}_unsure")]
    return scores.groupBy(*by).agg(*aggs)


def error_rates(counts: DataFrame, by: list[str]) -> DataFrame:
    """fp, fn and unsure rates in percent; a class without messages has rate 0."""
    rate = lambda a, b: F.round(100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)
    c = counts.withColumn("n", F.col("nham") + F.col("nspam")).withColumn("u", F.col("ham_unsure") + F.col("spam_unsure"))
    return c.select(*by, rate("ham_wrong", "nham").alias("fp_rate"), rate("spam_wrong", "nspam").alias("fn_rate"), rate("u", "n").alias("unsure_rate"))


def error_kind(o: EngineOptions = DEFAULT) -> Column:
    """fp, fn, unsure or null."""
    s, spam = F.col("score"), F.col("is_spam")
    return F.when(~spam & (s >= o.spam_cutoff), "fp").when(spam & (s < o.ham_cutoff), "fn").when((s >= o.ham_cutoff) & (s < o.spam_cutoff), "unsure")


def new_errors(scores: DataFrame, run: str, o: EngineOptions = DEFAULT) -> DataFrame:
    """run, kind, n_new: errors whose message made none of that kind in an earlier run."""
    rows = scores.withColumn("kind", error_kind(o)).where("kind IS NOT NULL")
    first = rows.groupBy("msg_id", "kind").agg(F.min(run).alias("run"))
    return first.groupBy("run", "kind").agg(F.count("*").alias("n_new"))


def hist_stats(scores: DataFrame, percentiles: tuple[float, ...] = DEFAULT.percentiles) -> DataFrame:
    """Per class n, least, greatest, median, mean, population variance and deviation, and percentiles of 100 * score."""
    x = F.col("score") * 100.0
    r = lambda c: F.round(c, 6) + 0.0
    aggs = [F.count("*").alias("n"), r(F.min(x)).alias("lo"), r(F.max(x)).alias("hi"), r(F.percentile(x, 0.5)).alias("median"), r(F.avg(x)).alias("mean"), r(F.var_pop(x)).alias("variance"), r(F.stddev_pop(x)).alias("sdev")]
    return scores.groupBy("is_spam").agg(*aggs, *[r(F.percentile(x, p / 100)).alias(f"p{p:g}") for p in percentiles])


def bucket(score: Column, n: int) -> Column:
    return F.least(F.greatest(F.floor(score * n).cast("int"), F.lit(0)), F.lit(n - 1))


def hist_buckets(scores: DataFrame, n: int = DEFAULT.nbuckets) -> DataFrame:
    """bucket, is_spam, n for every bucket and class, empty ones too."""
    every = scores.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket")).crossJoin(scores.select("is_spam").distinct())
    have = scores.groupBy(bucket(F.col("score"), n).alias("bucket"), "is_spam").agg(F.count("*").alias("k"))
    return every.join(have, ["bucket", "is_spam"], "left").select("bucket", "is_spam", F.coalesce("k", F.lit(0)).alias("n"))


def best_cutoffs(scores: DataFrame, o: EngineOptions = DEFAULT) -> DataFrame:
    """ham_cutoff, spam_cutoff, cost of every least costly pair of bucket edges, with the errors made there.

    Costs are compared in hundredths, as whole numbers. The pairs are (nbuckets + 1)^2 / 2, whatever the size of the data.
    """
    n = o.nbuckets
    fpw, fnw, unw = (round(w * 100) for w in (o.fp_weight, o.fn_weight, o.unsure_weight))
    b = bucket(F.col("score"), n)
    have = scores.groupBy(b.alias("b")).agg(_n(~F.col("is_spam")).alias("h"), _n(F.col("is_spam")).alias("s"))
    edges = scores.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("e"))
    at = edges.join(have, edges.e == have.b, "left")
    before = Window.orderBy("e").rowsBetween(Window.unboundedPreceding, -1)
    low = at.select("e", F.coalesce(F.sum("h").over(before), F.lit(0)).alias("hb"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("sb"))
    tot = have.agg(F.sum("h").alias("nh"), F.sum("s").alias("ns"))
    x, y = low.toDF("he", "hh", "hs"), low.toDF("se", "sh", "ss")
    pairs = x.join(F.broadcast(y), F.col("he") <= F.col("se")).crossJoin(F.broadcast(tot))
    pairs = pairs.select("he", "se", (F.col("nh") - F.col("sh")).alias("fp"), F.col("hs").alias("fn"), (F.col("sh") - F.col("hh")).alias("unsure_ham"), (F.col("ss") - F.col("hs")).alias("unsure_spam"))
    cost = F.col("fp") * fpw + F.col("fn") * fnw + (F.col("unsure_ham") + F.col("unsure_spam")) * unw
    pairs = pairs.withColumn("c", cost)
    least = pairs.agg(F.min("c").alias("least"))
    out = pairs.crossJoin(F.broadcast(least)).where("c = least")
    return out.select((F.col("he") / n).alias("ham_cutoff"), (F.col("se") / n).alias("spam_cutoff"), (F.col("c") / 100.0).alias("cost"), "fp", "fn", "unsure_ham", "unsure_spam")


def _lambda(s: Column, ham: Column, spam: Column) -> Column:
    return F.when(s < ham, 0.0).when(s > spam, 1.0).otherwise((s - ham) / (spam - ham))


def cost(kind: str, ham: Column, spam: Column, o: EngineOptions = DEFAULT) -> Column:
    """What one message costs: kind is std, flex or flex2."""
    s, bad = F.col("score"), F.col("is_spam")
    if kind == "std":
        on_spam = F.when(s < ham, F.lit(o.fn_weight)).when(s < spam, F.lit(o.unsure_weight)).otherwise(0.0)
        on_ham = F.when(s > spam, F.lit(o.fp_weight)).when(s > ham, F.lit(o.unsure_weight)).otherwise(0.0)
        return F.when(bad, on_spam).otherwise(on_ham)
    lam = _lambda(s, ham, spam)
    power = 2.0 if kind == "flex2" else 1.0
    return F.when(bad, F.pow(1 - lam, F.lit(power)) * o.fn_weight).otherwise(F.pow(lam, F.lit(power)) * o.fp_weight)


def total_cost(scores: DataFrame, kind: str, by: list[str], o: EngineOptions = DEFAULT, delayed: bool = False) -> DataFrame:
    """The summed cost; delayed uses the smallest of the best cutoffs instead of the given ones."""
    if delayed:
        best = best_cutoffs(scores, o).agg(F.min(F.struct("ham_cutoff", "spam_cutoff")).alias("b")).select("b.*")
        scores = scores.crossJoin(F.broadcast(best))
        c = cost(kind, F.col("ham_cutoff"), F.col("spam_cutoff"), o)
    else:
        c = cost(kind, F.lit(o.ham_cutoff), F.lit(o.spam_cutoff), o)
    return scores.groupBy(*by).agg(F.round(F.sum(c), 4).alias("cost"))


def cost_counts(scores: DataFrame, o: EngineOptions = DEFAULT) -> DataFrame:
    """The counting cost model: how many of each class are right, unsure and wrong by its own boundaries."""
    s, spam = F.col("score"), F.col("is_spam")
    return scores.agg(
        _n(~spam & (s > o.spam_cutoff)).alias("fp"), _n(spam & (s < o.ham_cutoff)).alias("fn"), _n(~spam & (s > o.ham_cutoff) & (s <= o.spam_cutoff)).alias("unsure_ham"),
        _n(spam & (s >= o.ham_cutoff) & (s < o.spam_cutoff)).alias("unsure_spam"), _n(~spam & (s <= o.ham_cutoff)).alias("correct_ham"), _n(spam & (s >= o.spam_cutoff)).alias("correct_spam"),
    )


def compare(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Two experiments run by run: v1, v2, outcome (won, lost, tied) and the change in percent, null where v1 is 0."""
    x, y = a.select(*on, F.col(value).alias("v1")), b.select(*on, F.col(value).alias("v2"))
    t = F.when(F.col("v1") == F.col("v2"), "tied").when(F.col("v1") < F.col("v2"), "lost").otherwise("won")
    return x.join(y, on).select(*on, "v1", "v2", t.alias("outcome"), F.round(F.try_divide((F.col("v2") - F.col("v1")) * 100.0, F.col("v1")), 6).alias("change"))


def k_statistic(scores: DataFrame, by: list[str]) -> DataFrame:
    """Class means and deviations of 100 * score, their distance and k, the distance in joint deviations."""
    x, spam = F.col("score") * 100.0, F.col("is_spam")
    m = lambda f, flag: f(F.when(flag, x))
    g = scores.groupBy(*by).agg(m(F.avg, ~spam).alias("hm"), m(F.avg, spam).alias("sm"), m(F.stddev_pop, ~spam).alias("hd"), m(F.stddev_pop, spam).alias("sd"))
    r = lambda c: F.round(c, 4) + 0.0
    return g.select(*by, r(F.col("hm")).alias("ham_mean"), r(F.col("hd")).alias("ham_sdev"), r(F.col("sm")).alias("spam_mean"), r(F.col("sd")).alias("spam_sdev"), r(F.col("sm") - F.col("hm")).alias("mean_diff"), r(F.try_divide(F.col("sm") - F.col("hm"), F.col("sd") + F.col("hd"))).alias("k"))


def prequential(messages: DataFrame, o: EngineOptions = DEFAULT, window: int | None = None) -> DataFrame:
    """msg_id, is_spam, score of messages (msg_id, seq, grp, is_spam, tokens), each scored by all before it in order of (grp, seq).

    With a window only messages of the last ``window`` groups before its own count. Counts are first summed by (token,
    group); running sums over groups and over one group's rows are then added, so no window sorts all rows of a
    token that every message holds.
    """
    spam = F.col("is_spam").cast("int")
    rows = exploded(messages, "msg_id", "seq", "grp", "is_spam")
    per = rows.groupBy("token", "grp").agg(F.sum(spam).alias("s"), F.sum(1 - spam).alias("h"))
    whole = Window.partitionBy("token").orderBy("grp")
    span = whole.rangeBetween(Window.unboundedPreceding if window is None else -window, -1)
    past = per.select("token", "grp", F.coalesce(F.sum("s").over(span), F.lit(0)).alias("ps"), F.coalesce(F.sum("h").over(span), F.lit(0)).alias("ph"))
    rows = rows.join(past, ["token", "grp"])
    if window is None:
        inner = Window.partitionBy("token", "grp").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("ps", F.col("ps") + F.coalesce(F.sum(spam).over(inner), F.lit(0))).withColumn("ph", F.col("ph") + F.coalesce(F.sum(1 - spam).over(inner), F.lit(0)))
    sizes = messages.groupBy("grp").agg(F.sum(spam).alias("s"), F.sum(1 - spam).alias("h"))
    all_ = Window.orderBy("grp").rangeBetween(Window.unboundedPreceding if window is None else -window, -1)
    base = sizes.select("grp", F.coalesce(F.sum("s").over(all_), F.lit(0)).alias("ns"), F.coalesce(F.sum("h").over(all_), F.lit(0)).alias("nh"))
    totals = messages.select("msg_id", "seq", "grp", "is_spam").join(base, "grp")
    if window is None:
        inner = Window.partitionBy("grp").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumn("ns", F.col("ns") + F.coalesce(F.sum(spam).over(inner), F.lit(0))).withColumn("nh", F.col("nh") + F.coalesce(F.sum(1 - spam).over(inner), F.lit(0)))
    known = rows.where("ps + ph > 0").select("msg_id", "token", "ps", "ph").join(totals.select("msg_id", "ns", "nh"), "msg_id")
    probs = known.select("msg_id", "token", probability(F.col("ps"), F.col("ph"), F.col("ns"), F.col("nh"), o).alias("prob"))
    found = clues(rows.select("msg_id", "token"), probs, o)
    return score(messages.select("msg_id", "is_spam"), found).select("msg_id", "is_spam", F.round("score", PLACES).alias("score"))
