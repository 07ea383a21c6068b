"""Queries over models, scores and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokensieve.functions.combine import chi2q, norm_iq, norm_p, norm_z
from tokensieve.functions.text import body_tokens, words
from tokensieve.operators import model as M
from tokensieve.operators import policy as P
from tokensieve.operators import score as S
from tokensieve.operators import what_if as W
from tokensieve.plans.base import LABELLED, MODEL, PROBS, TOK, chi2q_sql, labelled, messages, prob_sql, read, score_sql, tokens_sql

R = lambda c: F.round(c, 6) + 0.0


def learn_counts(s, d):
    return M.learn(labelled(s, d)).wordinfo


def model_totals(s, d):
    return M.learn(labelled(s, d)).meta


def unlearn_counts(s, d):
    m = labelled(s, d)
    return M.combine(M.learn(m), M.learn(m.where("lang = 'de'")), -1).wordinfo


def retrain_move(s, d):
    m = labelled(s, d)
    after = m.select("msg_id", F.when(F.col("lang") == "fr", ~F.col("is_spam")).otherwise(F.col("is_spam")).alias("is_spam"))
    return M.retrain(M.learn(m), m, after).wordinfo


def model_merge(s, d):
    m = labelled(s, d)
    return M.combine(M.learn(m.where("fold < 2")), M.learn(m.where("fold >= 2"))).wordinfo


def _probs(s, d):
    return M.token_probability(M.learn(labelled(s, d)))


def token_probability(s, d):
    return _probs(s, d).withColumn("prob", R(F.col("prob")))


def word_query_exact(s, d):
    return M.query_words(token_probability(s, d), "the")


def word_query_wildcard(s, d):
    return M.query_words(token_probability(s, d), "th*e", "wildcard", 20)


def word_query_regex(s, d):
    return M.query_words(token_probability(s, d), "skip:[a-f]", "regex", 10)


def token_counts(s, d):
    p = _probs(s, d).where(F.col("token").rlike("tion"))
    one = F.lit(1)
    return p.select("token", "spamcount", "hamcount", R(S.combined(F.log(1.0 - F.col("prob")), F.log("prob"), one)).alias("spamprob"))


def top_pure_words(s, d):
    m = M.learn(labelled(s, d))
    return M.pure_words(m, True, 20).unionByName(M.pure_words(m, False, 20))


def inverted_index(s, d):
    return M.inverted_index(labelled(s, d), 256).select("token", "is_spam", "block", "n_msgs", F.md5(F.array_join(F.col("msg_ids").cast("array<string>"), ",").cast("binary")).alias("ids"))


def feature_messages(s, d):
    m = labelled(s, d)
    hit = M.exploded(m, "msg_id").where(F.col("token").isin("idiot", "clown", "moron")).select("msg_id")
    return m.select("msg_id", "source").join(hit, "msg_id", "left_semi")


def score_documents(s, d):
    """The flagship: every document scored by the model of all labelled ones, and its category."""
    out = S.score_messages(messages(s, d), _probs(s, d))
    return out.select("msg_id", "n_clues", R(F.col("score")).alias("score"), P.category(F.round("score", 6)).alias("category"))


def _clues(s, d):
    return S.clues(M.exploded(labelled(s, d), "msg_id"), _probs(s, d))


def top_clues(s, d):
    return _clues(s, d).where("rank <= 10").select("msg_id", "rank", "token", R(F.col("prob")).alias("prob"))


def evidence(s, d):
    e = S.evidence(_clues(s, d))
    return e.select("msg_id", F.size("clues").alias("n"), F.element_at("clues", 1)["token"].alias("most_ham"), F.element_at("clues", -1)["token"].alias("most_spam"))


def clue_report(s, d):
    info = _probs(s, d).select("token", "spamcount", "hamcount")
    return _clues(s, d).where("rank <= 5").join(info, "token", "left").select("msg_id", "rank", "token", "spamcount", "hamcount", R(F.col("prob")).alias("prob"))


def bigram_tiling(s, d):
    docs = read(s, d, "documents").join(read(s, d, "labels"), "doc_id")
    m = docs.select(F.col("doc_id").alias("msg_id"), (F.col("toxic") == 1).alias("is_spam"), words(F.col("text")).alias("tokens"))
    from tokensieve.functions.text import bigrams

    both = m.withColumn("tokens", bigrams(F.col("tokens")))
    return S.tile_bigrams(m.select("msg_id", "tokens"), M.token_probability(M.learn(both)))


def categorize_strict(s, d):
    x = score_documents(s, d)
    return x.select("msg_id", P.category(F.col("score"), "filter").alias("category"))


def categorize_inclusive(s, d):
    x = score_documents(s, d)
    return x.select("msg_id", P.category(F.col("score"), "bulk").alias("category"))


def nway_language(s, d):
    docs = read(s, d, "documents").select(F.col("doc_id").alias("msg_id"), "lang", body_tokens(F.col("text")).alias("tokens"))
    out = None
    for i, lang in enumerate(("de", "en", "es", "fr")):
        m = docs.withColumn("is_spam", F.col("lang") == lang)
        sc = S.score_messages(docs, M.token_probability(M.learn(m))).select("msg_id", F.lit(i).alias("ordinal"), F.lit(lang).alias("model"), F.round("score", 6).alias("score"))
        out = sc if out is None else out.unionByName(sc)
    return S.best_model(out, 0.9)


def what_if_train(s, d):
    """How the scores of the unsure messages move when one unsure spam message is trained: delta counts, no retraining."""
    m = labelled(s, d)
    model = M.learn(m)
    found = S.clues(M.exploded(m, "msg_id"), M.token_probability(model))
    scored = S.score(m.select("msg_id", "is_spam"), found).withColumn("score", F.round("score", 6))
    unsure = scored.where("score >= 0.2 AND score < 0.9").select("msg_id", "is_spam")
    test = m.drop("is_spam").join(unsure, "msg_id").select("msg_id", "is_spam", "tokens")
    return W.what_if(test, model).select("cand", F.round(F.col("total") / F.col("n"), 5).alias("mean"), "new_spams")


def chi2_table(s, d):
    x = s.range(1, 61).select(F.col("id").alias("n"), F.explode(F.array(*[F.lit(float(v)) for v in (0.5, 2.0, 10.0, 40.0)])).alias("half"))
    return x.select("n", "half", R(chi2q(F.col("half"), F.col("n"))).alias("q"))


def normal_table(s, d):
    x = s.range(-40, 41).select(F.col("id").alias("i"), (F.col("id") / 10.0).alias("z"))
    return x.select("i", F.round(norm_p(F.col("z")), 6).alias("p"))


def normal_quantiles(s, d):
    x = s.range(0, 101).select(F.col("id").alias("i"), (F.col("id") / 100.0).alias("p"))
    return x.select("i", F.round(norm_z(F.col("p") * 4), 6).alias("density"), F.round(norm_iq(F.col("p")), 6).alias("z"))


def regime_query(name):
    def run(s, d):
        m = labelled(s, d)
        return P.replay(m.select("fold", "seq", "grp", "msg_id", "is_spam", "tokens"), name).select("fold", "msg_id", F.round("score", 6).alias("score"), "guess", "trained")

    return run


def tte_rounds(s, d):
    m = labelled(s, d)
    return P.exhaust(m.select("fold", "seq", "is_spam", "tokens"))


def culler_rules(s, d):
    c = read(s, d, "customer")
    rules = [(F.col("c_mktsegment") == "BUILDING", "keep"), (F.col("c_acctbal") < 0, "delete"), (F.col("c_nationkey") % 5 == 0, "move")]
    return c.select("c_custkey", P.first_rule(rules, "keep").alias("action"))


def disposition_header(s, d):
    x = score_documents(s, d)
    log = lambda p: F.concat(F.lit(" ("), F.floor(-F.log10(p)).cast("string"), F.lit(")"))
    sc = F.col("score")
    tail = F.when((sc <= 0.005) & (sc > 0), log(sc)).when((sc >= 0.995) & (sc < 1), log(F.round(1 - sc, 6))).otherwise("")
    return x.select("msg_id", F.concat(P.category(sc, "filter"), F.lit("; "), F.format_string("%.2f", F.bround(sc * 100, 0) / 100), tail).alias("header"))


def thermostat(s, d):
    return score_documents(s, d).select("msg_id", F.repeat(F.lit("*"), F.floor(F.col("score") * 10).cast("int")).alias("stars"))


def notations(s, d):
    c = read(s, d, "customer")
    return c.select("c_custkey", P.notate(F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("spam,"), "c_name")).otherwise(F.col("c_name")), F.lit("spam")).alias("subject"))


def crlf(s, d):
    return read(s, d, "documents").select("doc_id", F.md5(F.regexp_replace("text", "\r\n|\r|\n", "\r\n").cast("binary")).alias("digest"))


_score_all = f"{PROBS}, dtok AS (SELECT DISTINCT doc_id AS msg_id, unnest({tokens_sql('text')}) AS token FROM documents), {score_sql('dtok', 'probs', '(SELECT doc_id AS msg_id FROM documents)')}"
_cat = lambda lo, hi: f"CASE WHEN score {lo} 0.2 THEN 'ham' WHEN score {hi} 0.9 THEN 'spam' ELSE 'unsure' END"
_rs = f"{_score_all}, rs AS (SELECT msg_id, n_clues, round(score, 6) AS score FROM scored)"
_clue = f"{PROBS}, {score_sql('(SELECT DISTINCT msg_id, token FROM tok)', 'probs', '(SELECT msg_id FROM msgs)')}"


def _counts(where, a="spamcount", b="hamcount"):
    return f"sum((is_spam AND {where})::INT)::BIGINT AS {a}, sum((NOT is_spam AND {where})::INT)::BIGINT AS {b}"


def _nway():
    parts, ctes = [], []
    docs = f"docs AS (SELECT doc_id AS msg_id, lang, {tokens_sql('text')} AS tokens FROM documents), dtok AS (SELECT DISTINCT msg_id, lang, unnest(tokens) AS token FROM docs)"
    for i, g in enumerate(("de", "en", "es", "fr")):
        ctes.append(
            f"p{g} AS (SELECT token, {prob_sql('sc', 'hc', 'ns', 'nh')} AS prob FROM (SELECT token, sum((lang = '{g}')::INT)::BIGINT AS sc, sum((lang <> '{g}')::INT)::BIGINT AS hc FROM dtok GROUP BY token), (SELECT sum((lang = '{g}')::INT)::BIGINT AS ns, sum((lang <> '{g}')::INT)::BIGINT AS nh FROM docs))"
        )
        parts.append(f"SELECT msg_id, {i} AS ordinal, '{g}' AS model, round(score, 6) AS score FROM (WITH {score_sql('(SELECT msg_id, token FROM dtok)', 'p' + g, '(SELECT msg_id FROM docs)')} SELECT * FROM scored)")
    return f"WITH {docs}, {', '.join(ctes)}, alls AS ({' UNION ALL '.join(parts)}) SELECT msg_id, coalesce(arg_min(model, ordinal) FILTER (score >= 0.9), 'unsure') AS model FROM alls GROUP BY msg_id"


_what = (
    f"WITH {PROBS}, base AS (WITH {score_sql('(SELECT DISTINCT msg_id, token FROM tok)', 'probs', '(SELECT msg_id, is_spam FROM msgs)')} SELECT msg_id, is_spam FROM scored WHERE round(score, 6) >= 0.2 AND round(score, 6) < 0.9), "
    "cands AS (SELECT msg_id AS cand FROM base WHERE is_spam), ct AS (SELECT msg_id AS cand, token, 1 AS extra FROM tok JOIN cands ON msg_id = cand), tests AS (SELECT msg_id FROM base), pairs AS (SELECT c.cand, t.msg_id, t.token FROM tok t JOIN tests USING (msg_id), cands c), "
    "x AS (SELECT p.*, coalesce(w.spamcount, 0) + coalesce(ct.extra, 0) AS sc, coalesce(w.hamcount, 0) AS hc FROM pairs p LEFT JOIN ct ON p.cand = ct.cand AND p.token = ct.token LEFT JOIN wordinfo w ON p.token = w.token), "
    f"xp AS (SELECT cand, msg_id, token, {prob_sql('sc', 'hc', '(nspam + 1)', 'nham')} AS prob FROM x, meta WHERE sc + hc > 0), "
    f"{score_sql('pairs', 'xp', '(SELECT cand, msg_id FROM tests, cands)', 'cand, msg_id', 'cand, msg_id, token')} "
    "SELECT cand, round(avg(score), 5) AS mean, sum((round(score, 6) >= 0.9)::INT)::BIGINT AS new_spams FROM scored GROUP BY cand"
)

#: The normal distribution by its series, which converges well within the table.
_NORMAL = "SELECT i, round(0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 60), lambda k: z * pow(z * z, k) / list_product(list_transform(range(0, k + 1), lambda j: (2 * j + 1)::DOUBLE)))), 6) AS p FROM (SELECT i, i / 10.0::DOUBLE AS z FROM range(-40, 41) t(i))"

QUERIES = {
    "learn_counts": (learn_counts, f"WITH {MODEL} SELECT * FROM wordinfo"),
    "model_totals": (model_totals, f"WITH {MODEL} SELECT * FROM meta"),
    "unlearn_counts": (unlearn_counts, f"WITH {LABELLED}, {TOK}, c AS (SELECT token, {_counts("lang <> 'de'")} FROM tok GROUP BY token) SELECT * FROM c WHERE spamcount + hamcount > 0"),
    "retrain_move": (retrain_move, f"WITH {LABELLED}, {TOK}, c AS (SELECT token, sum(((lang = 'fr') <> is_spam)::INT)::BIGINT AS spamcount, sum(((lang = 'fr') = is_spam)::INT)::BIGINT AS hamcount FROM tok GROUP BY token) SELECT * FROM c"),
    "model_merge": (model_merge, f"WITH {MODEL} SELECT * FROM wordinfo"),
    "token_probability": (token_probability, f"WITH {PROBS} SELECT token, spamcount, hamcount, round(prob, 6) AS prob FROM probs"),
    "word_query_exact": (word_query_exact, f"WITH {PROBS} SELECT token, spamcount, hamcount, round(prob, 6) AS prob FROM probs WHERE token = 'the'"),
    "word_query_wildcard": (word_query_wildcard, f"WITH {PROBS}, m AS (SELECT token, spamcount, hamcount, round(prob, 6) AS prob FROM probs WHERE regexp_full_match(token, 'th.*e', 's')) SELECT *, (SELECT count(*) FROM m) AS n_all FROM (SELECT * FROM m ORDER BY token LIMIT 20)"),
    "word_query_regex": (word_query_regex, f"WITH {PROBS}, m AS (SELECT token, spamcount, hamcount, round(prob, 6) AS prob FROM probs WHERE regexp_matches(token, '^skip:[a-f]')) SELECT *, (SELECT count(*) FROM m) AS n_all FROM (SELECT * FROM m ORDER BY token LIMIT 10)"),
    "token_counts": (token_counts, f"WITH {PROBS} SELECT token, spamcount, hamcount, round(((1.0 - {chi2q_sql('-ln(1.0 - prob)', '1')}) - (1.0 - {chi2q_sql('-ln(prob)', '1')}) + 1.0) / 2.0, 6) AS spamprob FROM probs WHERE contains(token, 'tion')"),
    "top_pure_words": (top_pure_words, f"WITH {MODEL} (SELECT * FROM wordinfo WHERE hamcount = 0 AND NOT contains(token, ':') ORDER BY spamcount DESC, token LIMIT 20) UNION ALL (SELECT * FROM wordinfo WHERE spamcount = 0 AND NOT contains(token, ':') ORDER BY hamcount DESC, token LIMIT 20)"),
    "inverted_index": (inverted_index, f"WITH {LABELLED}, {TOK} SELECT token, is_spam, msg_id // 256 AS block, count(*) AS n_msgs, md5(string_agg(msg_id::VARCHAR, ',' ORDER BY msg_id)) AS ids FROM tok GROUP BY token, is_spam, msg_id // 256"),
    "feature_messages": (feature_messages, f"WITH {LABELLED}, {TOK} SELECT msg_id, source FROM msgs WHERE msg_id IN (SELECT msg_id FROM tok WHERE token IN ('idiot', 'clown', 'moron'))"),
    "score_documents": (score_documents, f"WITH {_rs} SELECT *, {_cat('<', '>=')} AS category FROM rs"),
    "top_clues": (top_clues, f"WITH {_clue} SELECT msg_id, rank, token, round(prob, 6) AS prob FROM clue WHERE rank <= 10"),
    "evidence": (evidence, f"WITH {_clue} SELECT msg_id, count(*) AS n, arg_min(token, {{'p': prob, 't': token}}) AS most_ham, arg_max(token, {{'p': prob, 't': token}}) AS most_spam FROM clue GROUP BY msg_id"),
    "clue_report": (clue_report, f"WITH {_clue} SELECT c.msg_id, c.rank, c.token, p.spamcount, p.hamcount, round(c.prob, 6) AS prob FROM clue c LEFT JOIN probs p USING (token) WHERE rank <= 5"),
    "bigram_tiling": (bigram_tiling, None),
    "categorize_strict": (categorize_strict, f"WITH {_rs} SELECT msg_id, {_cat('<', '>')} AS category FROM rs"),
    "categorize_inclusive": (categorize_inclusive, f"WITH {_rs} SELECT msg_id, {_cat('<=', '>=')} AS category FROM rs"),
    "nway_language": (nway_language, _nway()),
    "what_if_train": (what_if_train, _what),
    "chi2_table": (chi2_table, f"SELECT n, half, round({chi2q_sql('half', 'n')}, 6) AS q FROM range(1, 61) t(n), (SELECT unnest([0.5, 2.0, 10.0, 40.0])::DOUBLE AS half)"),
    "normal_table": (normal_table, _NORMAL),
    "normal_quantiles": (normal_quantiles, "SELECT i, round(exp(-8 * p * p) / sqrt(2 * pi()), 6) AS density, round(CASE WHEN p > 0.5 THEN -z ELSE z END, 6) AS z FROM (SELECT i, p, CASE WHEN q = 0 THEN 8.3 ELSE t - (2.30753 + 0.27061 * t) / (1.0 + 0.99229 * t + 0.04481 * t * t) END AS z FROM (SELECT i, p, q, CASE WHEN q > 0 THEN sqrt(-2 * ln(q)) END AS t FROM (SELECT i, i / 100.0::DOUBLE AS p, least(i, 100 - i) / 100.0::DOUBLE AS q FROM range(0, 101) t(i))))"),
    "regime_perfect": (regime_query("perfect"), None),
    "regime_corrected": (regime_query("corrected"), None),
    "regime_fpfnunsure": (regime_query("fpfnunsure"), None),
    "regime_fnunsure": (regime_query("fnunsure"), None),
    "regime_nonedge": (regime_query("nonedge"), None),
    "tte_rounds": (tte_rounds, None),
    "culler_rules": (culler_rules, "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'keep' WHEN c_acctbal < 0 THEN 'delete' WHEN c_nationkey % 5 = 0 THEN 'move' ELSE 'keep' END AS action FROM customer"),
    "disposition_header": (disposition_header, f"WITH {_rs} SELECT msg_id, {_cat('<', '>')} || '; ' || printf('%.2f', round_even(score * 100, 0) / 100) || CASE WHEN score <= 0.005 AND score > 0 THEN ' (' || floor(-log10(score))::INT || ')' WHEN score >= 0.995 AND score < 1 THEN ' (' || floor(-log10(round(1 - score, 6)))::INT || ')' ELSE '' END AS header FROM rs"),
    "thermostat": (thermostat, f"WITH {_rs} SELECT msg_id, repeat('*', floor(score * 10)::INT) AS stars FROM rs"),
    "notations": (notations, "SELECT c_custkey, 'spam,' || c_name AS subject FROM customer"),
    "crlf": (crlf, "SELECT doc_id, md5(regexp_replace(text, '\\r\\n|\\r|\\n', chr(13) || chr(10), 'g')) AS digest FROM documents"),
}
