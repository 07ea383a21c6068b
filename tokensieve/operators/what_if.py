"""What training one message more would do to the scores of others."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokensieve.operators.model import Model, exploded, probability
from tokensieve.options import DEFAULT, EngineOptions

#: Candidates and messages that one task pairs, about.
CANDIDATES, MESSAGES = 1024, 2048


def tail(half: np.ndarray, n: np.ndarray) -> np.ndarray:
    """combine.chi2q of arrays."""
    term = np.exp(-half)
    total = term.copy()
    for i in range(1, int(n.max(initial=0))):
        term = np.where(i < n, term * half / i, 0.0)
        total += term
    return np.minimum(total, 1.0)


def moved(p: np.ndarray, q: np.ndarray, hit: np.ndarray, o: EngineOptions = DEFAULT) -> np.ndarray:
    """Scores of a message, one for each row of hit: its tokens have probabilities q where hit, else p; nan is no clue.

    The strongest clues are chosen anew in each row; of equally strong ones those with the larger probability, and equal ones add the same.
    """
    prob = np.where(hit, q, p)
    dist = np.nan_to_num(np.abs(prob - 0.5), nan=-1.0)
    if prob.shape[1] > o.max_discriminators:
        best = np.lexsort((-prob, -dist), axis=1)[:, : o.max_discriminators]
        prob, dist = np.take_along_axis(prob, best, 1), np.take_along_axis(dist, best, 1)
    on = dist >= o.minimum_prob_strength
    prob, n = np.where(on, prob, 0.5), on.sum(axis=1)
    spam = 1.0 - tail(-np.where(on, np.log(1.0 - prob), 0.0).sum(axis=1), n)
    ham = 1.0 - tail(-np.where(on, np.log(prob), 0.0).sum(axis=1), n)
    return np.where(n > 0, (spam - ham + 1.0) / 2.0, 0.5)


def what_if(test: DataFrame, model: Model, o: EngineOptions = DEFAULT) -> DataFrame:
    """cand, n, total, new_spams for each spam message of test (msg_id, is_spam, tokens), were it trained: how many messages test has, the sum of their
    scores and how many of these, rounded to six places, reach the spam cutoff.

    Training adds one to the number of spam messages and to the counts of the candidate's tokens, so each token of a message has two probabilities.
    Candidates and messages are dealt into blocks, and each pair of blocks is compared in one task; a message that shares no
    clue with a candidate is scored once for all of those. Tokens that are no clue either way are not sent.
    """
    kind = test.schema["msg_id"].dataType.simpleString()
    size = test.agg(F.greatest(F.ceil(F.count_if("is_spam") / CANDIDATES), F.lit(1)).alias("blocks"), F.greatest(F.ceil(F.count("*") / MESSAGES), F.lit(1)).alias("slices"))
    spam, ham = F.col("spamcount"), F.col("hamcount")
    p, q = (probability(spam + extra, ham, F.col("nspam") + 1, F.col("nham"), o) for extra in (0, 1))
    both = model.wordinfo.crossJoin(F.broadcast(model.meta)).select("token", p.alias("p"), q.alias("q"))
    strong = both.where(" OR ".join(f"abs({c} - 0.5) >= {o.minimum_prob_strength!r}D" for c in "pq"))
    rows = exploded(test, "msg_id", "is_spam").join(strong, "token").groupBy("msg_id").agg(F.collect_list(F.struct("token", "p", "q")).alias("x"))
    rows = test.select("msg_id", "is_spam").join(rows, "msg_id", "left").crossJoin(F.broadcast(size))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    block, part = (F.pmod(F.xxhash64("msg_id"), F.col(n)) for n in ("blocks", "slices"))
    as_message = F.transform(every("blocks"), lambda b: F.struct(b.alias("b"), part.alias("s"), F.lit(False).alias("cand")))
    as_candidate = F.transform(every("slices"), lambda s: F.struct(block.alias("b"), s.alias("s"), F.lit(True).alias("cand")))
    places = F.when(F.col("is_spam"), F.concat(as_message, as_candidate)).otherwise(as_message)
    dealt = rows.select("msg_id", F.explode(places).alias("at"), F.col("x.token").alias("tokens"), F.col("x.p").alias("p"), F.col("x.q").alias("q")).select("msg_id", "at.*", "tokens", "p", "q")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cands, messages = pdf[pdf.cand], pdf[~pdf.cand]
        held = defaultdict(list)
        for i, tokens in enumerate(cands.tokens):
            for t in tokens if tokens is not None else ():
                held[t].append(i)
        total, spams = np.zeros(len(cands)), np.zeros(len(cands), np.int64)
        for tokens, p, q in zip(messages.tokens, messages.p, messages.q, strict=True) if len(cands) else ():
            if tokens is None:
                tokens, p, q = (), np.empty(0), np.empty(0)
            p, q = np.asarray(p, float), np.asarray(q, float)
            shared = [(i, j) for j, t in enumerate(tokens) for i in held.get(t, ())]
            who, row = np.unique(np.array([i for i, _ in shared], np.int64), return_inverse=True)
            hit = np.zeros((len(who) + 1, len(tokens)), bool)  # the last row is of those that share nothing
            hit[row, [j for _, j in shared]] = True
            scores = moved(p, q, hit, o)
            at = np.full(len(cands), scores[-1])
            at[who] = scores[:-1]
            total += at
            spams += np.floor(at * 1e6 + 0.5) / 1e6 >= o.spam_cutoff
        return pd.DataFrame({"cand": cands.msg_id, "n": len(messages), "total": total, "new_spams": spams})

    parts = dealt.groupBy("b", "s").applyInPandas(run, f"cand {kind}, n long, total double, new_spams long")
    return parts.groupBy("cand").agg(*[F.sum(c).alias(c) for c in ("n", "total", "new_spams")])
