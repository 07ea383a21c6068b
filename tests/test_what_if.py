"""what_if_train against one full scoring per candidate, and its plan where nothing is small enough to broadcast."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokensieve.operators import model as M
from tokensieve.operators import score as S
from tokensieve.operators import what_if as W
from tokensieve.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_no_product_of_tokens_and_candidates(spark):
    """A Cartesian product tokenizes the messages once for each pair of partitions."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()["what_if_train"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "CartesianProduct" not in plan


def test_same_as_scoring_with_the_model_after(spark, monkeypatch):
    monkeypatch.setattr(W, "CANDIDATES", 2)
    monkeypatch.setattr(W, "MESSAGES", 5)
    rnd = random.Random(7)
    sizes = [0, 3, 20, 160, 400]  # more tokens than clues are taken, too
    rows = [(i, i % 3 == 0, [f"w{rnd.randrange(700)}" for _ in range(sizes[i % 5])]) for i in range(40)]
    m = spark.createDataFrame(rows, "msg_id long, is_spam boolean, tokens array<string>").coalesce(1).cache()
    test = m.where("msg_id % 4 < 3")
    model = M.learn(m)
    got = {r.cand: r for r in W.what_if(test, model).collect()}
    assert sorted(got) == [i for i, spam, _ in rows if spam and i % 4 < 3]
    for c in (0, 6, 9, 18, 33):
        after = M.combine(model, M.learn(m.where(F.col("msg_id") == c)))
        want = [r.score for r in S.score_messages(test, M.token_probability(after)).collect()]
        assert got[c].n == len(want) == 30
        assert abs(got[c].total - sum(want)) < 1e-9
        assert got[c].new_spams == sum(round(x, 6) >= 0.9 for x in want)


def test_equally_strong_clues_fall_to_the_larger_probability():
    p = np.array([0.25] * 100 + [0.75] * 100)
    one = W.moved(p, p, np.zeros((1, 200), bool))[0]
    taken = W.moved(p[50:], p[50:], np.zeros((1, 150), bool))[0]
    assert one == pytest.approx(taken, abs=1e-12) and one > 0.8
