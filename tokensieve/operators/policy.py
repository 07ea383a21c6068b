"""Category boundaries, culler rules and training regimes."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokensieve.operators.model import Model, combine, learn
from tokensieve.options import DEFAULT, EngineOptions

#: For each component, whether a score on the ham cutoff is still ham and one on the spam cutoff already spam.
BOUNDARIES = {
    "tester": (False, True),
    "filter": (False, False),
    "bulk": (True, True),
}


def category(score: Column, boundary: str = "tester", o: EngineOptions = DEFAULT) -> Column:
    """ham, unsure or spam."""
    ham_on, spam_on = BOUNDARIES[boundary]
    ham = score <= o.ham_cutoff if ham_on else score < o.ham_cutoff
    spam = score >= o.spam_cutoff if spam_on else score > o.spam_cutoff
    return F.when(ham, "ham").when(spam, "spam").otherwise("unsure")


def first_rule(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The action of the first rule that holds."""
    out = None
    for cond, action in rules:
        out = F.when(cond, action) if out is None else out.when(cond, action)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def notate(text: Column, mark: Column) -> Column:
    """mark, a comma and the text, unless it is marked already."""
    return F.when(F.startswith(text, F.concat(mark, F.lit(","))), text).otherwise(F.concat(mark, F.lit(","), text))


class Counts:
    """A model in one task's memory, for replay in strict order."""

    def __init__(self, o: EngineOptions):
        self.o, self.words, self.n = o, {}, [0, 0]

    def train(self, tokens, spam: bool, sign: int = 1) -> None:
        self.n[spam] += sign
        for t in set(tokens):
            c = self.words.setdefault(t, [0, 0])
            c[spam] = max(0, c[spam] + sign)

    def score(self, tokens) -> float:
        o, nham, nspam = self.o, max(1, self.n[0]), max(1, self.n[1])
        found = []
        for t in set(tokens):
            ham, spam = self.words.get(t, (0, 0))
            if ham + spam:
                h, s = ham / nham, spam / nspam
                p = (o.unknown_word_strength * o.unknown_word_prob + (ham + spam) * (s / (h + s))) / (o.unknown_word_strength + ham + spam)
            else:
                p = o.unknown_word_prob
            if abs(p - 0.5) >= o.minimum_prob_strength:
                found.append((abs(p - 0.5), p, t))
        found = sorted(found)[-o.max_discriminators :]
        if not found:
            return 0.5

        def q(m: float, n: int) -> float:
            t = s = math.exp(-m)
            for i in range(1, n):
                t *= m / i
                s += t
            return min(1.0, s)

        n = len(found)
        return ((1 - q(-sum(math.log(1 - p) for _, p, _ in found), n)) - (1 - q(-sum(math.log(p) for _, p, _ in found), n)) + 1) / 2


#: name -> (guess -1/0/1, actual -1/1, score) -> -1/0/1 to train as; 1 is ham, -1 spam, 0 nothing.
REGIMES: dict[str, Callable[[int, int, float], int]] = {
    "perfect": lambda guess, actual, score: actual,
    "corrected": lambda guess, actual, score: guess,
    "balanced_corrected": lambda guess, actual, score: guess,
    "fpfnunsure": lambda guess, actual, score: actual if guess != actual else 0,
    "fnunsure": lambda guess, actual, score: actual if guess == 0 or (actual < 0 and guess > 0) else 0,
    "nonedge": lambda guess, actual, score: actual if guess != actual or 0.005 < score < 0.995 else 0,
}


#: Messages of a class that may be trained for each of the other before ``balanced_corrected`` trains no more of it on its own guess.
RATIO = 2.0
#: name -> (score, is_spam, options) -> True to train as spam, False as ham, None not at all.
DECISIONS: dict[str, Callable[[float, bool, EngineOptions], bool | None]] = {
    "all": lambda s, spam, o: spam,
    "allbut0and100": lambda s, spam, o: spam if (s < 0.995 if spam else s > 0.005) else None,
    "unsureonly": lambda s, spam, o: spam if o.ham_cutoff < s < o.spam_cutoff else None,
    "unsureandfalses": lambda s, spam, o: spam if (s < o.spam_cutoff if spam else s > o.ham_cutoff) else None,
    "owndecision": lambda s, spam, o: False if s < o.ham_cutoff else True if s > o.spam_cutoff else None,
    "owndecision+fn": lambda s, spam, o: True if spam else DECISIONS["owndecision"](s, spam, o),
}


def weak_test(messages: DataFrame, decision: str, first_n: int = 0, o: EngineOptions = DEFAULT) -> DataFrame:
    """fold, msg_id, score, trained (1 ham, -1 spam, 0 not) of messages (fold, seq, msg_id, is_spam, tokens) learned one by one in order of seq.

    Each is scored by what was trained before it; the decision says whether to train it. The first ``first_n`` - 1 messages are all trained. A fold is one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, out, decide = Counts(o), [], DECISIONS[decision]
        for i, r in enumerate(pdf.sort_values("seq").itertuples(index=False), 1):
            s = m.score(r.tokens)
            as_spam = bool(r.is_spam) if i < first_n else decide(s, bool(r.is_spam), o)
            if as_spam is not None:
                m.train(r.tokens, as_spam)
            out.append((r.fold, r.msg_id, s, 0 if as_spam is None else -1 if as_spam else 1))
        return pd.DataFrame(out, columns=["fold", "msg_id", "score", "trained"])

    return messages.groupBy("fold").applyInPandas(run, "fold long, msg_id long, score double, trained int")


def train_on_filter(model: Model, messages: DataFrame, probs: DataFrame, o: EngineOptions = DEFAULT) -> tuple[DataFrame, Model]:
    """Scored messages (msg_id, score, category, trained) of (msg_id, tokens, trained), and the model that has learned its own guesses.

    What a message was trained as before (ham, spam or null) is unlearned first; an unsure message is trained as ham.
    """
    from tokensieve.operators.score import score_messages

    known = messages.where("trained IS NOT NULL").select("msg_id", (F.col("trained") == "spam").alias("is_spam"), "tokens")
    scored = score_messages(messages.select("msg_id", "tokens"), probs, o).select("msg_id", "score")
    scored = scored.withColumn("category", category(F.col("score"), "filter", o)).withColumn("trained", F.when(F.col("category") == "spam", "spam").otherwise("ham"))
    guessed = messages.select("msg_id", "tokens").join(scored, "msg_id").select("msg_id", (F.col("trained") == "spam").alias("is_spam"), "tokens")
    return scored, combine(combine(model, learn(known), -1), learn(guessed))


def cull(messages: DataFrame, trained: DataFrame, key: str) -> DataFrame:
    """The messages whose key was trained."""
    return messages.join(trained.select(key).distinct(), key, "left_semi")


def size_limited(score: Column, size: Column, limit: int) -> Column:
    """The score, or 0 for a message that is not below the limit."""
    return F.when(size < limit, score).otherwise(F.lit(0.0))


def replay(messages: DataFrame, regime: str, o: EngineOptions = DEFAULT) -> DataFrame:
    """fold, msg_id, score, guess, trained for messages (fold, seq, grp, msg_id, is_spam, tokens) replayed in order of seq in each fold.

    Each message is scored by what was trained before it. ``corrected`` trains on its own guesses and puts the wrong ones right when the
    group changes; ``balanced_corrected`` does not train a guess of the class of which RATIO times as many have been trained. The order is strict, so a fold is one task; folds run side by side.
    """
    decide = REGIMES[regime]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        m, out, wrong, group = Counts(o), [], [], None
        for r in pdf.itertuples(index=False):
            if group is not None and r.grp != group:
                for tokens, guess, actual in wrong:
                    if guess:
                        m.train(tokens, guess < 0, -1)
                    m.train(tokens, actual < 0)
                wrong = []
            group = r.grp
            s = m.score(r.tokens)
            guess = 1 if s < o.ham_cutoff else -1 if s >= o.spam_cutoff else 0
            actual = -1 if r.is_spam else 1
            as_ = decide(guess, actual, s)
            skip = False
            if regime == "balanced_corrected" and guess and all(m.n):
                ratio = m.n[0] / m.n[1]
                skip = (ratio > RATIO and guess == 1) or (ratio < 1 / RATIO and guess == -1)
            if skip:
                as_ = 0
            if as_:
                m.train(r.tokens, as_ < 0)
            if regime in ("corrected", "balanced_corrected") and guess != actual and not skip:
                wrong.append((r.tokens, guess, actual))
            out.append((r.fold, r.msg_id, s, guess, as_))
        return pd.DataFrame(out, columns=["fold", "msg_id", "score", "guess", "trained"])

    return messages.groupBy("fold").applyInPandas(run, "fold long, msg_id long, score double, guess int, trained int")


def exhaust(messages: DataFrame, rounds: int = 10, o: EngineOptions = DEFAULT) -> DataFrame:
    """fold, round, misses, trained of training to exhaustion: rounds over all messages, training on misses, until a round has none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        m, out = Counts(o), []
        for k in range(1, rounds + 1):
            misses = 0
            for r in pdf.itertuples(index=False):
                s = m.score(r.tokens)
                if (r.is_spam and s < o.spam_cutoff) or (not r.is_spam and s > o.ham_cutoff):
                    misses += 1
                    m.train(r.tokens, bool(r.is_spam))
            out.append((int(pdf["fold"].iloc[0]), k, misses, sum(m.n)))
            if not misses:
                break
        return pd.DataFrame(out, columns=["fold", "round", "misses", "trained"])

    return messages.groupBy("fold").applyInPandas(run, "fold long, round int, misses int, trained int")


def maximize(f: Callable[[list[float]], float], start: list[float], step: list[float], rounds: int = 60) -> tuple[list[float], float]:
    """A simplex search for the point where f is largest; f may run a Spark job."""
    points = [(f(start), list(start))]
    for i, d in enumerate(step):
        p = list(start)
        p[i] += d
        points.append((f(p), p))
    n = len(start)
    for _ in range(rounds):
        points.sort(key=lambda x: -x[0])
        worst, best = points[-1], points[0]
        mid = [sum(p[1][i] for p in points[:-1]) / n for i in range(n)]
        at = lambda k, m=mid, w=worst: [m[i] + k * (m[i] - w[1][i]) for i in range(n)]
        tried = (f(at(1)), at(1))
        if tried[0] > best[0]:
            far = (f(at(2)), at(2))
            points[-1] = max(far, tried)
        elif tried[0] > points[-2][0]:
            points[-1] = tried
        else:
            near = (f(at(-0.5)), at(-0.5))
            if near[0] > worst[0]:
                points[-1] = near
            else:
                points = [best] + [(f(q), q) for q in ([(a + b) / 2 for a, b in zip(p[1], best[1], strict=True)] for p in points[1:])]
    top = max(points)
    return top[1], top[0]


def tune(messages: DataFrame, start: dict[str, float], step: float = 0.01, rounds: int = 60, kind: str = "flex", o: EngineOptions = DEFAULT) -> tuple[dict[str, float], float]:
    """The options (named in ``start``) at which cross-validation of messages costs least, by a simplex search, and that cost. Each trial is a Spark job."""
    from dataclasses import replace

    from tokensieve.operators.evaluate import cross_validate, total_cost

    names = list(start)

    def gain(values: list[float]) -> float:
        try:
            trial = replace(o, **dict(zip(names, values, strict=True)))
        except ValueError:  # outside what the options allow
            return -math.inf
        return -(total_cost(cross_validate(messages, o=trial), kind, [], trial).first()["cost"] or 0.0)

    best, value = maximize(gain, [start[n] for n in names], [step] * len(names), rounds)
    return dict(zip(names, best, strict=True)), -value
