"""Queries over evaluation, corpus management, statistics and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokensieve.functions.text import body_tokens
from tokensieve.operators import corpus as C
from tokensieve.operators import evaluate as E
from tokensieve.operators import model as M
from tokensieve.operators import stats as ST
from tokensieve.plans.base import CV, FOLD_MODELS, LABELLED, TOK, labelled, prob_sql, read, score_sql
from tokensieve.plans.model_queries import _score_all as _SCORE_ALL
from tokensieve.plans.text_queries import clean_sql


def cv_subtract(s, d):
    return E.cross_validate(labelled(s, d))


def cv_scratch(s, d):
    return E.cross_validate(labelled(s, d), "scratch")


def grid(s, d):
    g = E.grid(labelled(s, d))
    return g.groupBy("train_fold", "test_fold", "is_spam").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean"))


def confusion(s, d):
    return E.confusion(cv_subtract(s, d), ["fold"])


def error_rates(s, d):
    return E.error_rates(confusion(s, d), ["fold"])


def new_errors_per_run(s, d):
    g = E.grid(labelled(s, d)).withColumn("run", F.col("train_fold"))
    return E.new_errors(g, "run")


def hist_stats(s, d):
    return E.hist_stats(cv_subtract(s, d))


def hist_buckets(s, d):
    return E.hist_buckets(cv_subtract(s, d))


def hist_render(s, d):
    h = E.hist_buckets(cv_subtract(s, d))
    most = h.agg(F.greatest(F.ceil(F.max("n") / 60), F.lit(1)).alias("unit"))
    return h.crossJoin(F.broadcast(most)).select("bucket", "is_spam", F.concat(F.format_string("%5.1f %4d ", F.col("bucket") * 100.0 / 200, F.col("n")), F.repeat(F.lit("*"), F.ceil(F.col("n") / F.col("unit")).cast("int"))).alias("line"))


def best_cutoffs(s, d):
    return E.best_cutoffs(cv_subtract(s, d))


def cost_query(kind, delayed=False):
    def run(s, d):
        return E.total_cost(cv_subtract(s, d), kind, [], delayed=delayed)

    return run


def cost_counts(s, d):
    return E.cost_counts(cv_subtract(s, d))


def run_totals(s, d):
    x = cv_subtract(s, d).withColumn("kind", E.error_kind())
    n = lambda k: F.coalesce(F.sum((F.col("kind") == k).cast("int")), F.lit(0)).cast("long")
    t = x.agg(n("fp").alias("fp"), n("fn").alias("fn"), n("unsure").alias("un"), F.count("*").alias("n"))
    return t.select("fp", "fn", "un", F.round(100.0 * F.col("un") / F.col("n"), 6).alias("unsure_percent"), F.round(F.col("fp") * 10.0 + F.col("fn") * 1.0 + F.col("un") * 0.2, 4).alias("cost"))


def rates_summary(s, d):
    r = error_rates(s, d)
    return r.agg(*[F.round(F.avg(c), 5).alias(c) for c in ("fp_rate", "fn_rate", "unsure_rate")], F.count("*").alias("runs"))


def _single(s, d):
    """A second experiment: each fold scored by a model of the next fold alone."""
    g = E.grid(labelled(s, d)).where((F.col("train_fold") == (F.col("test_fold") + 1) % 5))
    return g.select("msg_id", "is_spam", F.col("test_fold").alias("fold"), "score")


def ab_compare(s, d):
    b = E.error_rates(E.confusion(_single(s, d), ["fold"]), ["fold"])
    return E.compare(error_rates(s, d), b, ["fold"], "unsure_rate")


def experiment_table(s, d):
    a, b = cv_subtract(s, d).withColumn("experiment", F.lit("all")), _single(s, d).select("msg_id", "is_spam", "fold", "score").withColumn("experiment", F.lit("one"))
    return E.k_statistic(a.unionByName(b), ["experiment"])


def prequential_perfect(s, d):
    return E.prequential(labelled(s, d))


def prequential_expire(s, d):
    return E.prequential(labelled(s, d), window=3)


def _docs(s, d):
    return read(s, d, "documents")


def dedup_exact(s, d):
    return C.first_copies(_docs(s, d), "text", "doc_id").select("doc_id", "first", "n")


def fuzzy_checksum(s, d):
    return C.checksum_keys(read(s, d, "documents"), "doc_id", "text").select("doc_id", "sub")


def fuzzy_matches(s, d):
    return C.fuzzy_matches(_docs(s, d), "doc_id", "text")


def checksum_lru(s, d):
    k = C.checksum_keys(_docs(s, d), "doc_id", "text").groupBy("sub").agg(F.max("doc_id").alias("seen"))
    return C.newest(k, [F.desc("seen"), F.desc("sub")], 2**14 - 20)


def sort_and_group(s, d):
    return C.group_by_day(read(s, d, "events"), "ts").groupBy("grp").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def mksets(s, d):
    g = _docs(s, d).select("doc_id", F.floor(F.col("doc_id") / 50).alias("grp"))
    return C.deal_sets(g, "doc_id", "grp", 5, 4, 12)


def equal_partitions(s, d):
    return C.equal_parts(_docs(s, d).select("doc_id"), "doc_id", 10)


def expire(s, d):
    return C.expire(read(s, d, "events"), "ts", F.to_timestamp(F.lit("2024-01-20 00:00:00")), 7).select("event_id", "user_id")


def snapshot_diff(s, d):
    o = read(s, d, "orders")
    a, b = o.where("o_orderdate < '1997-01-01'").select("o_custkey").distinct(), o.where("o_orderdate >= '1997-01-01'").select("o_custkey").distinct()
    return C.snapshot_diff(a, b, "o_custkey")


def identical_copies(s, d):
    docs = _docs(s, d)
    bad = docs.join(read(s, d, "labels").where("toxic = 1"), "doc_id")
    return C.identical(docs.select("doc_id", "text"), bad, "text").select("doc_id", "is_spam")


def search(s, d):
    docs = _docs(s, d).withColumnRenamed("doc_id", "msg_id")
    conv = read(s, d, "conversations").withColumn("msg_id", F.col("conv_id") * 1000 + F.col("turn"))
    bench = read(s, d, "benchmark").withColumnRenamed("item_id", "msg_id")
    return C.search({"documents": docs, "conversations": conv, "benchmark": bench}, "text", "heation", 40)


def whitelist(s, d):
    c, o = read(s, d, "customer"), read(s, d, "orders")
    good = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    bad = c.where("c_acctbal < 0").select("c_custkey")
    return c.join(good, "c_custkey", "left_semi").join(bad, "c_custkey", "left_anti").select("c_custkey", "c_name")


def day_navigation(s, d):
    return C.days_around(read(s, d, "events"), "ts")


def daily_volumes(s, d):
    x = read(s, d, "events").withColumn("age", F.datediff(F.to_date(F.lit("2024-02-01")), F.to_date("ts"))).where("age < 120")
    return x.groupBy(F.floor(F.col("age") / 2).alias("slot"), "event_type").agg(F.count("*").alias("n"))


def _daily(s, d):
    x = read(s, d, "events").groupBy(F.to_date("ts").alias("day"))
    return x.agg(F.sum((F.col("event_type") != "error").cast("long")).alias("good"), F.count("*").alias("n"))


def success_curve(s, d):
    return C.success_curve(_daily(s, d), "day", "good", "n")


def span_average(s, d):
    return C.span_average(_daily(s, d), "day", "good", "n", 7)


def split_sets(s, d):
    return C.split_n(_docs(s, d).select("doc_id"), "doc_id", 10, 1).groupBy("part").agg(F.count("*").alias("n"))


def split_percent(s, d):
    return C.split_percent(_docs(s, d).select("doc_id"), "doc_id", 30.0, 1).groupBy("part").agg(F.count("*").alias("n"))


def sample_keep(s, d):
    return C.sample_keep(_docs(s, d).select("doc_id", "source"), "source", "doc_id", 5, 7)


def rebalance(s, d):
    sets = _docs(s, d).select("doc_id", (F.length("source") % 3).alias("set_no"))
    return C.rebalance(sets, "doc_id", "set_no", 120)


def interleave(s, d):
    return C.interleave(labelled(s, d).select("msg_id", "is_spam"), "msg_id").select("msg_id", "is_spam", "pos")


def _info(s, d):
    x = cv_subtract(s, d).join(read(s, d, "labels").select(F.col("doc_id").alias("msg_id"), "quality"), "msg_id")
    c = F.when(F.col("score") < 0.2, "h").when(F.col("score") >= 0.9, "s").otherwise("u")
    return x.select("msg_id", c.alias("c"), F.when(F.col("quality") == 1, F.col("is_spam")).alias("t"))


def lifetime_stats(s, d):
    return ST.lifetime(_info(s, d))


def derived_stats(s, d):
    return ST.derived(ST.lifetime(_info(s, d)))


def stats_report(s, d):
    return ST.report(ST.derived(ST.lifetime(_info(s, d))))


def _stream(s, d, table):
    """(stream, out): a table's files as a stream, and a fresh folder for what comes of it, shared by driver and executors."""
    import os
    import tempfile
    import uuid

    base = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp()
    src = f"{d}/{table}.parquet"
    local = src if os.path.isdir(src) or "://" in src else d
    stream = s.readStream.schema(s.read.parquet(src).schema).option("pathGlobFilter", "*.parquet" if local != d else f"{table}.parquet").parquet(local)
    return stream, f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _run_stream(writer, out):
    q = writer.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()


def stream_scores(s, d):
    """Documents arrive as a stream and are scored by a model snapshot; the sink is a folder of Parquet."""
    from tokensieve.streaming.online import score_batch

    probs = M.token_probability(M.learn(labelled(s, d)))
    stream, out = _stream(s, d, "documents")

    def each(batch, epoch):
        scored = score_batch(batch.select(F.col("doc_id").alias("msg_id"), "text"), probs)
        scored.select("msg_id", F.round("score", 6).alias("score")).write.mode("overwrite").parquet(f"{out}/{epoch}")

    _run_stream(stream.writeStream.foreachBatch(each), out)
    return s.read.parquet(f"{out}/*")


def stream_daily(s, d):
    """The watermarked daily counts of a stream of events; each batch brings the counts of all windows up to date."""
    from tokensieve.streaming.online import daily_volumes as counts

    stream, out = _stream(s, d, "events")
    rows = counts(stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("category")))
    flat = rows.select(F.to_date("window.start").alias("day"), F.col("category").alias("event_type"), "n")
    _run_stream(flat.writeStream.outputMode("complete").foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(out)), out)
    return s.read.parquet(out)


_CV = f"WITH {CV}"
_CONF = "SELECT fold, sum((NOT is_spam)::INT)::BIGINT AS nham, sum(is_spam::INT)::BIGINT AS nspam, " + ", ".join(
    f"sum(({own} AND {cond})::INT)::BIGINT AS {name}"
    for own, name, cond in (
        ("NOT is_spam", "ham_right", "score < 0.2"), ("NOT is_spam", "ham_wrong", "score >= 0.9"), ("NOT is_spam", "ham_unsure", "score >= 0.2 AND score < 0.9"),
        ("is_spam", "spam_right", "score >= 0.9"), ("is_spam", "spam_wrong", "score < 0.2"), ("is_spam", "spam_unsure", "score >= 0.2 AND score < 0.9"),
    )
)
_RATES = "SELECT fold, round(100.0 * ham_wrong / greatest(nham, 1), 6) AS fp_rate, round(100.0 * spam_wrong / greatest(nspam, 1), 6) AS fn_rate, round(100.0 * (ham_unsure + spam_unsure) / greatest(nham + nspam, 1), 6) AS unsure_rate FROM conf"
_GRID = (
    f"{FOLD_MODELS}, gp AS (SELECT t.token, t.fold AS train_fold, {prob_sql('sum(t.is_spam::INT)::BIGINT', 'sum((NOT t.is_spam)::INT)::BIGINT', 'any_value(f.ns)', 'any_value(f.nh)')} AS prob FROM tok t JOIN folds f ON t.fold = f.fold GROUP BY t.token, t.fold), "
    f"gt AS (SELECT t.msg_id, f.fold AS train_fold, t.token FROM tok t JOIN folds f ON t.fold <> f.fold), "
    f"{score_sql('gt', 'gp', '(SELECT m.msg_id, m.is_spam, m.fold AS test_fold, f.fold AS train_fold FROM msgs m JOIN folds f ON m.fold <> f.fold)', 'msg_id, train_fold', 'token, train_fold')}, g AS (SELECT train_fold, test_fold, msg_id, is_spam, round(score, 6) AS score FROM scored)"
)
_KIND = "CASE WHEN NOT is_spam AND score >= 0.9 THEN 'fp' WHEN is_spam AND score < 0.2 THEN 'fn' WHEN score >= 0.2 AND score < 0.9 THEN 'unsure' END"
_BUCKET = "least(greatest(floor(score * 200)::INT, 0), 199)"
_CUTS = (
    f"hb AS (SELECT {_BUCKET} AS b, sum((NOT is_spam)::INT)::BIGINT AS h, sum(is_spam::INT)::BIGINT AS s FROM cv GROUP BY 1), "
    "low AS (SELECT e::INT AS e, coalesce((SELECT sum(h) FROM hb WHERE b < e), 0)::BIGINT AS h, coalesce((SELECT sum(s) FROM hb WHERE b < e), 0)::BIGINT AS s FROM range(0, 201) t(e)), "
    "tot AS (SELECT sum(h)::BIGINT AS nh FROM hb), "
    "prs AS (SELECT a.e AS he, b.e AS se, nh - b.h AS fp, a.s AS fn, b.h - a.h AS unsure_ham, b.s - a.s AS unsure_spam FROM low a JOIN low b ON a.e <= b.e, tot), "
    "pc AS (SELECT *, fp * 1000 + fn * 100 + (unsure_ham + unsure_spam) * 20 AS c FROM prs), "
    "bests AS (SELECT he / 200.0::DOUBLE AS ham_cutoff, se / 200.0::DOUBLE AS spam_cutoff, c / 100.0::DOUBLE AS cost, fp, fn, unsure_ham, unsure_spam FROM pc WHERE c = (SELECT min(c) FROM pc))"
)


def _cost(kind, h="0.2::DOUBLE", sp="0.9::DOUBLE"):
    if kind == "std":
        return f"CASE WHEN is_spam THEN CASE WHEN score < {h} THEN 1.0 WHEN score < {sp} THEN 0.2 ELSE 0.0 END ELSE CASE WHEN score > {sp} THEN 10.0 WHEN score > {h} THEN 0.2 ELSE 0.0 END END::DOUBLE"
    lam = f"(CASE WHEN score < {h} THEN 0.0 WHEN score > {sp} THEN 1.0 ELSE (score - {h}) / ({sp} - {h}) END::DOUBLE)"
    p = 2 if kind == "flex2" else 1
    return f"CASE WHEN is_spam THEN pow(1 - {lam}, {p}) * 1.0 ELSE pow({lam}, {p}) * 10.0 END"


def _cost_sql(kind):
    return f"{_CV} SELECT round(sum({_cost(kind)}), 4) AS cost FROM cv"


_DELAY = f"{_CV}, {_CUTS}, b AS (SELECT ham_cutoff, spam_cutoff FROM bests ORDER BY 1, 2 LIMIT 1) SELECT round(sum({_cost('std', 'ham_cutoff', 'spam_cutoff')}), 4) AS cost FROM cv, b"
_HS = "round(min(x), 6) AS lo, round(max(x), 6) AS hi, round(quantile_cont(x, 0.5), 6) AS median, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, round(stddev_pop(x), 6) AS sdev, " + ", ".join(f"round(quantile_cont(x, {p / 100}), 6) AS p{p}" for p in (5, 25, 75, 95))
_SINGLE = "one AS (SELECT msg_id, is_spam, test_fold AS fold, score FROM g WHERE train_fold = (test_fold + 1) % 5)"


def _prequential_sql(window):
    cond = "b.seq < a.seq" if window is None else f"b.grp < a.grp AND b.grp >= a.grp - {window}"
    return (
        f"WITH {LABELLED}, {TOK}, pt AS (SELECT a.msg_id, a.token, coalesce(sum(b.is_spam::INT), 0)::BIGINT AS sc, coalesce(sum((NOT b.is_spam)::INT), 0)::BIGINT AS hc FROM tok a LEFT JOIN tok b ON a.token = b.token AND {cond} GROUP BY a.msg_id, a.token), "
        f"pm AS (SELECT a.msg_id, coalesce(sum(b.is_spam::INT), 0)::BIGINT AS ns, coalesce(sum((NOT b.is_spam)::INT), 0)::BIGINT AS nh FROM msgs a LEFT JOIN msgs b ON {cond} GROUP BY a.msg_id), "
        f"pp AS (SELECT msg_id, token, {prob_sql('sc', 'hc', 'ns', 'nh')} AS prob FROM pt JOIN pm USING (msg_id) WHERE sc + hc > 0), {score_sql('tok', 'pp', '(SELECT msg_id, is_spam FROM msgs)', 'msg_id', 'msg_id, token')} SELECT msg_id, is_spam, round(score, 6) AS score FROM scored"
    )


_LINES = f"string_split({clean_sql('text')}, chr(10))"
_CK = f"ck AS (SELECT doc_id, list_transform(range(0, 4), lambda i: md5(array_to_string(list_slice(l, i * (len(l) // 4 + 1) + 1, (i + 1) * (len(l) // 4 + 1)), chr(10)))) AS c FROM (SELECT doc_id, {_LINES} AS l FROM documents)), subs AS (SELECT doc_id, unnest(['0:' || c[1] || '.' || c[2], '1:' || c[2] || '.' || c[3], '2:' || c[3] || '.' || c[4]]) AS sub FROM ck)"
_LIFE = (
    "sum((c = 'h')::INT)::BIGINT AS num_ham, sum((c = 's')::INT)::BIGINT AS num_spam, sum((c = 'u')::INT)::BIGINT AS num_unsure, sum((c = 'u' AND t IS NOT NULL AND NOT t)::INT)::BIGINT AS num_trained_ham, "
    "sum((c = 's' AND t IS NOT NULL AND NOT t)::INT)::BIGINT AS num_trained_ham_fp, sum((c = 'u' AND t IS NOT NULL AND t)::INT)::BIGINT AS num_trained_spam, sum((c = 'h' AND t IS NOT NULL AND t)::INT)::BIGINT AS num_trained_spam_fn"
)
_INFO = f"{_CV}, info AS (SELECT cv.msg_id, CASE WHEN score < 0.2 THEN 'h' WHEN score >= 0.9 THEN 's' ELSE 'u' END AS c, CASE WHEN quality = 1 THEN is_spam END AS t FROM cv JOIN labels ON cv.msg_id = labels.doc_id), life AS (SELECT {_LIFE} FROM info)"
_pc = lambda a, b, n: f"round(100.0 * {a} / nullif({b}, 0), 6) AS {n}"
_DER = (
    f"{_INFO}, a AS (SELECT *, num_ham + num_spam + num_unsure AS num_seen, num_ham - num_trained_spam_fn AS num_ham_correct, num_spam - num_trained_ham_fp AS num_spam_correct FROM life), "
    "b AS (SELECT *, num_ham_correct + num_spam_correct AS num_correct, num_trained_spam_fn + num_trained_ham_fp AS num_incorrect, num_trained_ham - num_trained_ham_fp AS num_unsure_trained_ham, num_trained_spam - num_trained_spam_fn AS num_unsure_trained_spam, num_ham_correct + num_trained_ham AS total_ham, num_spam_correct + num_trained_spam AS total_spam FROM a), "
    "c AS (SELECT *, num_unsure - num_unsure_trained_ham - num_unsure_trained_spam AS num_unsure_not_trained FROM b), "
    "e AS (SELECT *, " + ", ".join(_pc(a, b, n) for n, (a, b) in {
        "perc_ham": ("num_ham", "num_seen"), "perc_spam": ("num_spam", "num_seen"), "perc_unsure": ("num_unsure", "num_seen"), "perc_correct": ("num_correct", "num_seen"), "perc_incorrect": ("num_incorrect", "num_seen"),
        "perc_fp": ("num_trained_ham_fp", "num_seen"), "perc_fn": ("num_trained_spam_fn", "num_seen"), "perc_unsure_trained_ham": ("num_unsure_trained_ham", "num_unsure"), "perc_unsure_trained_spam": ("num_unsure_trained_spam", "num_unsure"),
        "perc_unsure_not_trained": ("num_unsure_not_trained", "num_unsure"), "perc_ham_incorrect": ("num_trained_ham_fp", "total_ham"), "perc_ham_unsure": ("num_unsure_trained_ham", "total_ham"),
        "perc_spam_correct": ("num_spam_correct", "total_spam"), "perc_spam_unsure": ("num_unsure_trained_spam", "total_spam"),
    }.items()) + ", round(num_trained_ham_fp * 10.0 + num_trained_spam_fn * 1.0 + num_unsure * 0.2, 6)::DOUBLE AS total_cost FROM c) "
    "SELECT *, round(num_spam * 1.0 - total_cost, 6)::DOUBLE AS cost_savings FROM e"
)
_DAY = "daily AS (SELECT ts::DATE AS day, sum((event_type <> 'error')::INT)::BIGINT AS good, count(*) AS n FROM events GROUP BY 1)"

_REBALANCE = (
    "WITH a AS (SELECT doc_id, length(source) % 3 AS s, row_number() OVER (PARTITION BY length(source) % 3 ORDER BY md5('0:' || doc_id)) AS r FROM documents), "
    "spare AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id)) AS n FROM a WHERE s = 0 OR r > 120), "
    "need AS (SELECT s, greatest(120 - count(*), 0) AS need FROM a WHERE s <> 0 GROUP BY s), upto AS (SELECT s, need, sum(need) OVER (ORDER BY s) AS b FROM need) "
    "SELECT doc_id, s::INT AS set_no FROM a WHERE s <> 0 AND r <= 120 UNION ALL SELECT doc_id, coalesce((SELECT min(s) FROM upto WHERE n > b - need AND n <= b), 0)::INT FROM spare"
)
_LINES_SQL = ", ".join(
    [
        "'Messages classified: ' || num_seen", *[f"'{t}: ' || num_{c} || ' (' || printf('%.1f', perc_{c}) || '%)'" for t, c in (("Ham", "ham"), ("Spam", "spam"), ("Unsure", "unsure"))],
        "'False positives: ' || num_trained_ham_fp", "'False negatives: ' || num_trained_spam_fn", "'Total cost: $' || printf('%.2f', total_cost)",
    ]
)

QUERIES = {
    "cv_subtract": (cv_subtract, f"{_CV} SELECT * FROM cv"),
    "cv_scratch": (cv_scratch, f"{_CV} SELECT * FROM cv"),
    "grid": (grid, f"WITH {_GRID} SELECT train_fold, test_fold, is_spam, count(*) AS n, round(avg(score), 5) AS mean FROM g GROUP BY 1, 2, 3"),
    "confusion": (confusion, f"{_CV} {_CONF} FROM cv GROUP BY fold"),
    "error_rates": (error_rates, f"{_CV}, conf AS ({_CONF} FROM cv GROUP BY fold) {_RATES}"),
    "new_errors_per_run": (new_errors_per_run, f"WITH {_GRID}, k AS (SELECT msg_id, {_KIND} AS kind, min(train_fold) AS run FROM g GROUP BY 1, 2) SELECT run, kind, count(*) AS n_new FROM k WHERE kind IS NOT NULL GROUP BY run, kind"),
    "hist_stats": (hist_stats, f"{_CV} SELECT is_spam, count(*) AS n, {_HS} FROM (SELECT is_spam, score * 100.0::DOUBLE AS x FROM cv) GROUP BY is_spam"),
    "hist_buckets": (hist_buckets, f"{_CV}, k AS (SELECT {_BUCKET} AS bucket, is_spam, count(*) AS k FROM cv GROUP BY 1, 2) SELECT b::INT AS bucket, x.is_spam, coalesce(k, 0) AS n FROM range(0, 200) t(b) CROSS JOIN (SELECT DISTINCT is_spam FROM cv) x LEFT JOIN k ON k.bucket = b AND k.is_spam = x.is_spam"),
    "hist_render": (hist_render, f"{_CV}, k AS (SELECT {_BUCKET} AS bucket, is_spam, count(*) AS k FROM cv GROUP BY 1, 2), h AS (SELECT b::INT AS bucket, x.is_spam, coalesce(k, 0) AS n FROM range(0, 200) t(b) CROSS JOIN (SELECT DISTINCT is_spam FROM cv) x LEFT JOIN k ON k.bucket = b AND k.is_spam = x.is_spam), u AS (SELECT greatest(ceil(max(n) / 60.0), 1) AS unit FROM h) SELECT bucket, is_spam, printf('%5.1f %4d ', bucket * 100.0::DOUBLE / 200, n) || repeat('*', ceil(n / unit)::INT) AS line FROM h, u"),
    "best_cutoffs": (best_cutoffs, f"{_CV}, {_CUTS} SELECT * FROM bests"),
    "cost_std": (cost_query("std"), _cost_sql("std")),
    "cost_flex": (cost_query("flex"), _cost_sql("flex")),
    "cost_flex2": (cost_query("flex2"), _cost_sql("flex2")),
    "cost_delayed": (cost_query("std", True), _DELAY),
    "cost_counts": (cost_counts, f"{_CV} SELECT sum((NOT is_spam AND score > 0.9)::INT)::BIGINT AS fp, sum((is_spam AND score < 0.2)::INT)::BIGINT AS fn, sum((NOT is_spam AND score > 0.2 AND score <= 0.9)::INT)::BIGINT AS unsure_ham, sum((is_spam AND score >= 0.2 AND score < 0.9)::INT)::BIGINT AS unsure_spam, sum((NOT is_spam AND score <= 0.2)::INT)::BIGINT AS correct_ham, sum((is_spam AND score >= 0.9)::INT)::BIGINT AS correct_spam FROM cv"),
    "run_totals": (run_totals, f"{_CV}, k AS (SELECT {_KIND} AS kind FROM cv), t AS (SELECT sum(coalesce(kind = 'fp', false)::INT)::BIGINT AS fp, sum(coalesce(kind = 'fn', false)::INT)::BIGINT AS fn, sum(coalesce(kind = 'unsure', false)::INT)::BIGINT AS un, count(*) AS n FROM k) SELECT fp, fn, un, round(100.0 * un / n, 6) AS unsure_percent, round(fp * 10.0::DOUBLE + fn + un * 0.2::DOUBLE, 4) AS cost FROM t"),
    "rates_summary": (rates_summary, f"{_CV}, conf AS ({_CONF} FROM cv GROUP BY fold), r AS ({_RATES}) SELECT round(avg(fp_rate), 5) AS fp_rate, round(avg(fn_rate), 5) AS fn_rate, round(avg(unsure_rate), 5) AS unsure_rate, count(*) AS runs FROM r"),
    "ab_compare": (ab_compare, f"{_CV}, conf AS ({_CONF} FROM cv GROUP BY fold), ra AS ({_RATES}), rb AS (WITH {_GRID}, {_SINGLE}, conf AS ({_CONF} FROM one GROUP BY fold) {_RATES}) SELECT ra.fold, ra.unsure_rate AS v1, rb.unsure_rate AS v2, CASE WHEN ra.unsure_rate = rb.unsure_rate THEN 'tied' WHEN ra.unsure_rate < rb.unsure_rate THEN 'lost' ELSE 'won' END AS outcome, round((rb.unsure_rate - ra.unsure_rate) * 100.0 / nullif(ra.unsure_rate, 0), 6) AS change FROM ra JOIN rb ON ra.fold = rb.fold"),
    "experiment_table": (experiment_table, f"{_CV}, x AS (SELECT 'all' AS experiment, is_spam, score * 100.0::DOUBLE AS v FROM cv UNION ALL SELECT 'one', is_spam, score * 100.0::DOUBLE FROM (WITH {_GRID}, {_SINGLE} SELECT * FROM one)), g AS (SELECT experiment, avg(v) FILTER (NOT is_spam) AS hm, avg(v) FILTER (is_spam) AS sm, stddev_pop(v) FILTER (NOT is_spam) AS hd, stddev_pop(v) FILTER (is_spam) AS sd FROM x GROUP BY 1) SELECT experiment, round(hm, 4) AS ham_mean, round(hd, 4) AS ham_sdev, round(sm, 4) AS spam_mean, round(sd, 4) AS spam_sdev, round(sm - hm, 4) AS mean_diff, round((sm - hm) / nullif(sd + hd, 0), 4) AS k FROM g"),
    "prequential_perfect": (prequential_perfect, _prequential_sql(None)),
    "prequential_expire": (prequential_expire, _prequential_sql(3)),
    "dedup_exact": (dedup_exact, "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first, count(*) OVER (PARTITION BY text) AS n FROM documents"),
    "fuzzy_checksum": (fuzzy_checksum, f"WITH {_CK} SELECT * FROM subs"),
    "fuzzy_matches": (fuzzy_matches, f"WITH {_CK}, f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sub) AS first FROM subs) SELECT doc_id, min(first) AS first FROM f WHERE first < doc_id GROUP BY doc_id"),
    "checksum_lru": (checksum_lru, f"WITH {_CK}, k AS (SELECT sub, max(doc_id) AS seen FROM subs GROUP BY sub) SELECT * FROM k ORDER BY seen DESC, sub DESC LIMIT 16364"),
    "sort_and_group": (sort_and_group, "SELECT floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 86400000000)::BIGINT AS grp, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1"),
    "mksets": (mksets, "WITH r AS (SELECT doc_id, doc_id // 50 AS grp, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS k, dense_rank() OVER (ORDER BY doc_id // 50) AS g FROM documents) SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 5 + 1)::INT AS set_no FROM r WHERE g <= 12 AND k <= 20 UNION ALL SELECT doc_id, 0 FROM r WHERE NOT (g <= 12 AND k <= 20)"),
    "equal_partitions": (equal_partitions, "SELECT doc_id, ntile(10) OVER (ORDER BY md5('0:' || doc_id)) AS part FROM documents"),
    "expire": (expire, "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY"),
    "snapshot_diff": (snapshot_diff, "WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < '1997-01-01'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= '1997-01-01') SELECT o_custkey, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT o_custkey, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"),
    "identical_copies": (identical_copies, "SELECT doc_id, text IN (SELECT text FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1) AS is_spam FROM documents"),
    "search": (search, "SELECT * FROM (SELECT 'documents' AS corpus, doc_id AS msg_id FROM documents WHERE contains(lower(text), 'heation') UNION ALL SELECT 'conversations', conv_id * 1000 + turn FROM conversations WHERE contains(lower(text), 'heation') UNION ALL SELECT 'benchmark', item_id FROM benchmark WHERE contains(lower(text), 'heation')) ORDER BY corpus, msg_id LIMIT 40"),
    "whitelist": (whitelist, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND NOT c_acctbal < 0"),
    "day_navigation": (day_navigation, "SELECT day, n, lag(day) OVER (ORDER BY day) AS prior, lead(day) OVER (ORDER BY day) AS next FROM (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)"),
    "daily_volumes": (daily_volumes, "SELECT (DATE '2024-02-01' - ts::DATE) // 2 AS slot, event_type, count(*) AS n FROM events WHERE DATE '2024-02-01' - ts::DATE < 120 GROUP BY 1, 2"),
    "success_curve": (success_curve, f"WITH {_DAY} SELECT day, (sum(good) OVER w)::BIGINT AS right_so_far, (sum(n) OVER w)::BIGINT AS total_so_far, round((sum(good) OVER w) / (sum(n) OVER w)::DOUBLE, 6) AS ratio FROM daily WINDOW w AS (ORDER BY day)"),
    "span_average": (span_average, f"WITH {_DAY} SELECT day, round((sum(good) OVER w) / (sum(n) OVER w)::DOUBLE, 6) AS rate FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"),
    "split_sets": (split_sets, "SELECT (('0x' || substr(md5('1:' || doc_id), 1, 15))::BIGINT % 10)::INT AS part, count(*) AS n FROM documents GROUP BY 1"),
    "split_percent": (split_percent, "SELECT CASE WHEN (('0x' || substr(md5('1:' || doc_id), 1, 15))::BIGINT % 1000000) / 10000.0::DOUBLE < 30 THEN 1 ELSE 2 END AS part, count(*) AS n FROM documents GROUP BY 1"),
    "sample_keep": (sample_keep, "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id)) AS r FROM documents) WHERE r <= 5"),
    "rebalance": (rebalance, _REBALANCE),
    "interleave": (interleave, f"WITH {LABELLED}, a AS (SELECT msg_id, is_spam, (row_number() OVER (PARTITION BY is_spam ORDER BY msg_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY is_spam) AS place FROM msgs) SELECT msg_id, is_spam, row_number() OVER (ORDER BY place, is_spam, msg_id) AS pos FROM a"),
    "lifetime_stats": (lifetime_stats, f"{_INFO} SELECT * FROM life"),
    "derived_stats": (derived_stats, _DER),
    "stats_report": (stats_report, f"WITH der AS ({_DER}) SELECT line_no, line FROM (SELECT unnest(l) AS line, generate_subscripts(l, 1)::INT - 1 AS line_no FROM (SELECT [{_LINES_SQL}] AS l FROM der))"),
    "stream_scores": (stream_scores, f"WITH {_SCORE_ALL} SELECT msg_id, round(score, 6) AS score FROM scored"),
    "stream_daily": (stream_daily, "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}
