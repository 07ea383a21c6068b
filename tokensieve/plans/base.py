"""Tables that several queries start from, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensieve.functions.text import body_tokens

WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
WORD_TOKENS = (
    "CASE WHEN length(w) < 3 THEN []::VARCHAR[] WHEN length(w) <= 12 THEN [w] "
    "WHEN length(w) < 40 AND contains(w, '.') AND len(string_split(w, '@')) = 2 THEN ['email name:' || string_split(w, '@')[1], 'email addr:' || string_split(w, '@')[2]] "
    "ELSE list_concat(['skip:' || w[1:1] || ' ' || (length(w) // 10 * 10)::VARCHAR], "
    r"CASE WHEN regexp_matches(w, '[\x{80}-\x{ff}]') THEN ['8bit%:' || round_even(length(regexp_replace(w, '[\x00-\x7f]', '', 'g')) * 100.0::DOUBLE / length(w), 0)::BIGINT::VARCHAR] ELSE []::VARCHAR[] END) END"
)


def tokens_sql(text: str) -> str:
    return f"flatten(list_transform(list_filter(string_split_regex(lower(coalesce({text}, '')), '{WS}'), lambda w: length(w) > 0), lambda w: {WORD_TOKENS}))"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, is_spam, fold, seq, grp, source, lang, tokens of the labelled documents."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id")
    return rows.select(
        F.col("doc_id").alias("msg_id"), (F.col("toxic") == 1).alias("is_spam"), (F.col("doc_id") % 5).alias("fold"), F.col("doc_id").alias("seq"),
        F.floor(F.col("doc_id") / 100).alias("grp"), "source", "lang", body_tokens(F.col("text")).alias("tokens"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, tokens of all documents."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"), body_tokens(F.col("text")).alias("tokens"))


LABELLED = f"msgs AS (SELECT d.doc_id AS msg_id, l.toxic = 1 AS is_spam, d.doc_id % 5 AS fold, d.doc_id AS seq, d.doc_id // 100 AS grp, d.source, d.lang, {tokens_sql('d.text')} AS tokens FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
TOK = "tok AS (SELECT DISTINCT msg_id, is_spam, fold, seq, grp, lang, unnest(tokens) AS token FROM msgs)"
MODEL = (
    f"{LABELLED}, {TOK}, wordinfo AS (SELECT token, sum(is_spam::INT)::BIGINT AS spamcount, sum((NOT is_spam)::INT)::BIGINT AS hamcount FROM tok GROUP BY token), "
    "meta AS (SELECT coalesce(sum(is_spam::INT), 0)::BIGINT AS nspam, coalesce(sum((NOT is_spam)::INT), 0)::BIGINT AS nham FROM msgs)"
)


def prob_sql(spam: str = "spamcount", ham: str = "hamcount", nspam: str = "nspam", nham: str = "nham") -> str:
    h, s = f"({ham} / greatest({nham}, 1)::DOUBLE)", f"({spam} / greatest({nspam}, 1)::DOUBLE)"
    return f"((0.225::DOUBLE + ({ham} + {spam}) * ({s} / ({h} + {s}))) / (0.45::DOUBLE + ({ham} + {spam})))"


PROBS = f"{MODEL}, probs AS (SELECT token, spamcount, hamcount, {prob_sql()} AS prob FROM wordinfo, meta)"


def chi2q_sql(m: str, n: str) -> str:
    return f"least(1.0::DOUBLE, list_sum(list_transform(range(0, {n}), lambda i: exp(-({m}) + i * ln({m}) - lgamma(i + 1))))::DOUBLE)"


def score_sql(tokens: str, probs: str, ids: str, by: str = "msg_id", on: str = "token", keep: str = "") -> str:
    """CTEs clue, sums and scored: by, keep, n_clues, score; tokens and probs are tables, ids has every message."""
    cols = [c.strip() for c in by.split(",")]
    t = ", ".join(f"t.{c}" for c in cols)
    join = " AND ".join(f"i.{c} = s.{c}" for c in cols)
    return (
        f"dist AS (SELECT {t}, t.token, coalesce(p.prob, 0.5::DOUBLE) AS prob, abs(coalesce(p.prob, 0.5::DOUBLE) - 0.5) AS dist FROM {tokens} t LEFT JOIN {probs} p USING ({on})), "
        f"clue AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY dist DESC, prob DESC, token DESC) AS rank FROM dist WHERE dist >= 0.1::DOUBLE) WHERE rank <= 150), "
        f"sums AS (SELECT {by}, -sum(ln(1.0 - prob)) AS s, -sum(ln(prob)) AS h, count(*) AS n FROM clue GROUP BY {by}), "
        f"scored AS (SELECT i.*, coalesce(n, 0) AS n_clues, CASE WHEN n > 0 THEN ((1.0 - {chi2q_sql('s.s', 's.n')}) - (1.0 - {chi2q_sql('s.h', 's.n')}) + 1.0) / 2.0 ELSE 0.5 END AS score FROM {ids} i LEFT JOIN sums s ON {join})"
    )


SCORED = f"{PROBS}, {score_sql('(SELECT DISTINCT msg_id, token FROM tok)', 'probs', '(SELECT msg_id, is_spam, fold, source, lang FROM msgs)')}"
FOLD_MODELS = (
    f"{LABELLED}, {TOK}, folds AS (SELECT fold, sum(is_spam::INT)::BIGINT AS ns, sum((NOT is_spam)::INT)::BIGINT AS nh FROM msgs GROUP BY fold), "
    "fmeta AS (SELECT a.fold, sum(b.ns)::BIGINT AS nspam, sum(b.nh)::BIGINT AS nham FROM folds a JOIN folds b ON a.fold <> b.fold GROUP BY a.fold), "
    "finfo AS (SELECT t.token, f.fold, sum(t.is_spam::INT)::BIGINT AS spamcount, sum((NOT t.is_spam)::INT)::BIGINT AS hamcount FROM tok t JOIN folds f ON t.fold <> f.fold GROUP BY t.token, f.fold)"
)
CV_RAW = f"{FOLD_MODELS}, fprobs AS (SELECT token, fold, {prob_sql()} AS prob FROM finfo JOIN fmeta USING (fold)), {score_sql('tok', 'fprobs', '(SELECT msg_id, is_spam, fold FROM msgs)', 'msg_id, fold', 'token, fold')}"
CV = f"{CV_RAW}, cv AS (SELECT msg_id, is_spam, fold, round(score, 6) AS score FROM scored)"
