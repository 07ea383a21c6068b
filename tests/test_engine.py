"""Exact cases and invariants of the classification engine."""

import math

import pytest
from pyspark.sql import functions as F

from tokensieve.functions import text as T
from tokensieve.functions.combine import chi2q
from tokensieve.operators import evaluate as E
from tokensieve.operators import model as M
from tokensieve.operators import policy as P
from tokensieve.operators import score as S
from tokensieve.operators import stats as ST
from tokensieve.options import EngineOptions
from tokensieve.sources import mail, store


def msgs(spark, rows):
    return spark.createDataFrame(rows, "msg_id string, is_spam boolean, tokens array<string>")


def info(model):
    return {r.token: (r.hamcount, r.spamcount) for r in model.wordinfo.collect()}


def test_learn_and_totals(spark):
    m = M.learn(msgs(spark, [("1", True, ["some", "simple", "tokens"]), ("2", False, ["some", "other"]), ("3", False, ["ones"]), ("4", False, [])]))
    assert info(m) == {"some": (1, 1), "simple": (0, 1), "tokens": (0, 1), "other": (1, 0), "ones": (1, 0)}
    assert tuple(m.meta.first()) == (1, 3)


def test_hapax_leaves_and_returns(spark):
    all_ = msgs(spark, [("1", False, ["common", "nearly", "hapax", "hapax"]), ("2", False, ["common", "nearly"]), ("3", False, ["common"])])
    m, one = M.learn(all_), M.learn(all_.where("msg_id = '1'"))
    assert info(m) == {"common": (3, 0), "nearly": (2, 0), "hapax": (1, 0)}
    less = M.combine(m, one, -1)
    assert info(less) == {"common": (2, 0), "nearly": (1, 0)}
    assert info(M.combine(less, one)) == info(m)
    none = M.combine(m, m, -1)
    assert info(none) == {} and tuple(none.meta.first()) == (0, 0)
    with pytest.raises(Exception, match="more messages unlearned"):
        M.combine(one, m, -1).meta.collect()


def test_probabilities_scores_and_confusion(spark):
    m = M.learn(msgs(spark, [("1", False, ["a", "b", "c"]), ("2", False, ["a", "b"]), ("3", True, ["c", "d"])]))
    p = {r.token: r.prob for r in M.token_probability(m).collect()}
    assert {k: round(v, 6) for k, v in p.items()} == {"a": 0.091837, "b": 0.091837, "c": 0.636054, "d": 0.844828}
    test = msgs(spark, [("h1", False, ["a", "b"]), ("h2", False, ["d"]), ("s1", True, ["d"]), ("s2", True, ["a"]), ("s3", True, ["a", "b"]), ("s4", True, ["d", "a", "b"]), ("x", True, ["zzz"])])
    sc = S.score_messages(test, M.token_probability(m))
    got = {r.msg_id: round(r.score, 6) for r in sc.collect()}
    assert got == {"h1": 0.032525, "h2": 0.844828, "s1": 0.844828, "s2": 0.091837, "s3": 0.032525, "s4": 0.233942, "x": 0.5}
    o = EngineOptions(ham_cutoff=0.5, spam_cutoff=0.5)
    scores = sc.join(test, "msg_id").where("msg_id <> 'x'").withColumn("fold", F.lit(1))
    c = E.confusion(scores, ["fold"], o)
    r = c.first()
    assert (r.ham_right, r.ham_wrong, r.spam_right, r.spam_wrong) == (1, 1, 1, 3)
    e = E.error_rates(c, ["fold"]).first()
    assert (e.fp_rate, e.fn_rate, e.unsure_rate) == (50.0, 75.0, 0.0)
    mirror = M.learn(msgs(spark, [("1", True, ["a", "b", "c"]), ("2", True, ["a", "b"]), ("3", False, ["c", "d"])]))
    other = {r.msg_id: r.score for r in S.score_messages(test, M.token_probability(mirror)).collect()}
    assert all(abs(other[k] + v - 1) < 1e-5 for k, v in got.items())


def test_replay_scores_like_the_dataframes(spark):
    c = P.Counts(EngineOptions())
    for spam, tokens in ((False, ["a", "b", "c"]), (False, ["a", "b"]), (True, ["c", "d"])):
        c.train(tokens, spam)
    assert round(c.score(["d", "a", "b"]), 6) == 0.233942 and c.score(["zzz"]) == 0.5


def test_chi2q(spark):
    rows = spark.createDataFrame([(1.0, 1), (5.0, 2), (0.0, 1), (50.0, 150), (800.0, 2)], "half double, n long")
    got = [r.q for r in rows.select(chi2q(F.col("half"), F.col("n")).alias("q")).collect()]
    assert [round(x, 9) for x in got] == [round(math.exp(-1), 9), 0.040427682, 1.0, 1.0, 0.0]


def test_cross_validation_by_subtraction_is_from_scratch(spark):
    import random

    rnd = random.Random(1)
    rows = [(str(i), rnd.random() < 0.4, i % 3, [rnd.choice("abcdefghij") * 3 for _ in range(rnd.randint(0, 9))]) for i in range(60)]
    m = spark.createDataFrame(rows, "msg_id string, is_spam boolean, fold long, tokens array<string>")
    a = sorted(map(tuple, E.cross_validate(m).collect()))
    assert a == sorted(map(tuple, E.cross_validate(m, "scratch").collect())) and len(a) == 60


def test_words(spark):
    t = "Hi " + "ab " * 5 + "Hello x@y.zz.longer.name verylongwordindeed ünïcödeünïcödeü a b"
    r = spark.createDataFrame([(t,)], "t string").select(T.body_tokens(F.col("t")).alias("x"), T.short_run(F.col("t")).alias("s"), T.short_run_token(F.col("t")).alias("k")).first()
    assert r.x == ["hello", "email name:x", "email addr:y.zz.longer.name", "skip:v 10", "skip:ü 10", f"8bit%:{round(7 * 100 / 15)}"]
    assert r.s == 6 and r.k == "short:2"
    assert spark.createDataFrame([("", None)], "a string, b string").select(T.body_tokens(F.col("a")).alias("a"), T.body_tokens(F.col("b")).alias("b")).first() == ([], [])


def test_html_and_urls(spark):
    html = "A<style>x</style>b<!-- c -->d<P>e&nbsp;f<iframe src=cid:1 height=0>g <b>h</b> 1 < 2 see http://a.b/c?d=e. <!-- open"
    r = spark.createDataFrame([(html,)], "t string").select(T.strip_html(F.col("t")).alias("s"), T.virus_clues(F.col("t")).alias("v"), T.url_tokens(F.col("t")).alias("u")).first()
    assert r.s == "abd e fg h 1 < 2 see http://a.b/c?d=e. <!-- open"
    assert r.v == ["virus:<iframe", "virus:src=cid:", "virus:height=0"]
    assert r.u == ["proto:http", "url:a", "url:b", "url:c", "url:d", "url:e"]
    e = spark.createDataFrame([("&#97;&#98; &#0000000000009;",)], "t string").select(T.numeric_entities(F.col("t")).alias("x")).first()
    assert e.x.startswith("ab ")


def test_headers(spark):
    rows = spark.createDataFrame([("abc",), ("abc\n\n\n",), ("abc: xyz\n\n\n",), ("abc: xyz\r\n\r\nbody",)], "t string")
    assert [r.x for r in rows.select(T.header_block(F.col("t")).alias("x")).collect()] == ["", "", "abc: xyz\n", "abc: xyz\n"]
    got = spark.createDataFrame([("<x@y.z>", "bad")], "a string, b string").select(T.message_id_token(F.col("a")).alias("a"), T.message_id_token(F.col("b")).alias("b")).first()
    assert tuple(got) == ("message-id:@y.z", "message-id:invalid")


def test_lifetime_and_derived(spark):
    rows = [("s", True), ("s", False), ("h", True), ("h", False), ("h", None), ("u", False), ("u", True), ("u", None), ("u", None)]
    r = ST.lifetime(spark.createDataFrame(rows, "c string, t boolean")).first().asDict()
    assert r == {"num_ham": 3, "num_spam": 2, "num_unsure": 4, "num_trained_ham": 1, "num_trained_ham_fp": 1, "num_trained_spam": 1, "num_trained_spam_fn": 1}
    c = spark.createDataFrame([(23, 10, 12, 7, 3, 5, 4)], "num_ham long, num_spam long, num_unsure long, num_trained_ham long, num_trained_ham_fp long, num_trained_spam long, num_trained_spam_fn long")
    x = ST.derived(c).first()
    assert (x.num_ham_correct, x.num_spam_correct, x.num_unsure_trained_ham, x.num_unsure_not_trained, x.total_ham, x.total_spam, x.total_cost, x.cost_savings) == (19, 7, 4, 7, 26, 12, 36.4, -26.4)


def test_store_and_csv(spark, tmp_path):
    m = M.learn(msgs(spark, [("1", True, ["a,b", "c"]), ("2", False, ['q"x'])]))
    s = store.ModelStore(spark, str(tmp_path / "m"))
    s.save(m)
    assert info(s.load()) == info(m)
    store.export_csv(m, str(tmp_path / "csv"))
    back = store.import_csv(spark, str(tmp_path / "csv"))
    assert info(back) == info(m) and tuple(back.meta.first()) == (1, 1)
    twice = store.import_csv(spark, str(tmp_path / "csv"), back)
    assert info(twice) == {k: (2 * a, 2 * b) for k, (a, b) in info(m).items()}


def test_mail_sources(spark, tmp_path):
    (tmp_path / "box").write_bytes(b"From a@b Mon Jan 1\nSubject: one\nTo: x@y.z\n\nhello\nFrom c@d Tue\nno header here\n")
    got = mail.parse(mail.read_messages(spark, str(tmp_path / "box"), "mbox")).orderBy("msg_id")
    rows = got.select("*", mail.header("subject").alias("s")).collect()
    assert rows[0].s == "one" and rows[0].body == "hello\n" and len(rows) == 2 and rows[1].s is None


def test_stream_learns_and_scores(spark, tmp_path):
    from tokensieve.streaming import online

    st = store.ModelStore(spark, str(tmp_path / "model"))
    st.save(online.empty_model(spark))
    rows = [("1", "idiot clown", True, 1), ("2", "good morning", False, 1)]
    spark.createDataFrame(rows, "msg_id string, text string, is_spam boolean, sign int").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("msg_id string, text string, is_spam boolean, sign int").parquet(str(tmp_path / "in"))
    q = online.learn_stream(src, st, str(tmp_path / "cp1"))
    q.processAllAvailable()
    q.stop()
    assert info(st.load())["idiot"] == (0, 1)
    got = []
    q = online.score_stream(src.select("msg_id", "text"), st, lambda df, e: got.extend(df.collect()), str(tmp_path / "cp2"))
    q.processAllAvailable()
    q.stop()
    assert {r.msg_id: r.score > 0.5 for r in got} == {"1": True, "2": False}


def test_simplex():
    at, best = P.maximize(lambda p: -((p[0] - 3) ** 2) - (p[1] + 1) ** 2, [0.0, 0.0], [1.0, 1.0])
    assert best > -1e-4 and abs(at[0] - 3) < 0.02


def test_rebalance(spark):
    from tokensieve.operators import corpus as C

    sets = spark.createDataFrame([(i, 1 if i < 7 else 2 if i < 9 else 0) for i in range(12)], "k long, set_no int")
    got = C.rebalance(sets, "k", "set_no", 4).groupBy("set_no").count().collect()
    assert {r.set_no: r["count"] for r in got} == {1: 4, 2: 4, 0: 4}


def test_null_contents_are_copies_of_each_other(spark):
    from tokensieve.operators import corpus as C

    rows = spark.createDataFrame([(1, "x"), (2, None), (3, None), (4, "y")], "k long, t string")
    assert sorted((r.k, r.first, r.n) for r in C.first_copies(rows, "t", "k").collect()) == [(1, 1, 1), (2, 2, 2), (3, 2, 2), (4, 4, 1)]


def test_ranked_is_row_number(spark):
    from tokensieve.operators import corpus as C

    rows = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None, (i * 37) % 50) for i in range(300)], "k long, g string, o long")
    got = {r.k: r.n for r in C.ranked(rows, ["g"], F.col("o"), [F.col("k")], "n", 8).collect()}
    for g in ("a", "b", None):
        mine = sorted((r.o, r.k) for r in rows.collect() if r.g == g)
        assert [got[k] for _, k in mine] == list(range(1, len(mine) + 1))
    assert C.ranked(rows.limit(0), [], F.col("o"), [], "n").count() == 0


def replay_by_hand(rows, regime, o):
    """The regimes as their rules say, message by message, with the model kept as plain lists."""
    trained, out, wrong, group = [], [], [], None

    def probability(t):
        ham, spam = (sum(t in x for x, s in trained if s is b) for b in (False, True))
        if not ham + spam:
            return 0.5
        nh, ns = (max(1, sum(s is b for _, s in trained)) for b in (False, True))
        return (0.45 * 0.5 + (ham + spam) * (spam / ns / (ham / nh + spam / ns))) / (0.45 + ham + spam)

    def score(tokens):
        p = [x for x in map(probability, set(tokens)) if abs(x - 0.5) >= 0.1]
        if not p:
            return 0.5

        def q(m, n):
            return min(1.0, sum(math.exp(-m + i * math.log(m) - math.lgamma(i + 1)) for i in range(n)))

        s, h = (1 - q(-sum(math.log(f(x)) for x in p), len(p)) for f in (lambda x: 1 - x, lambda x: x))
        return (s - h + 1) / 2

    for grp, is_spam, tokens in rows:
        if group is not None and grp != group and regime in ("corrected", "balanced_corrected"):
            for tk, guess, spam in wrong:
                if guess:
                    trained.remove((tk, guess < 0))
                trained.append((tk, spam))
            wrong = []
        group = grp
        s = score(tokens)
        guess, actual = (1 if s < o.ham_cutoff else -1 if s >= o.spam_cutoff else 0), (-1 if is_spam else 1)
        n = [sum(x is b for _, x in trained) for b in (False, True)]
        if regime in ("corrected", "balanced_corrected"):
            as_ = guess
            if regime == "balanced_corrected" and guess and all(n) and ((n[0] / n[1] > 2 and guess == 1) or (n[0] / n[1] < 0.5 and guess == -1)):
                as_ = 0
            elif guess != actual:
                wrong.append((tokens, guess, is_spam))
        elif regime == "fpfnunsure":
            as_ = actual if guess != actual else 0
        elif regime == "fnunsure":
            as_ = actual if guess != actual and guess >= 0 else 0
        elif regime == "nonedge":
            as_ = actual if guess != actual or 0.005 < s < 0.995 else 0
        else:
            as_ = actual
        if as_:
            trained.append((tokens, as_ < 0))
        out.append((round(s, 6), guess, as_))
    return out


@pytest.mark.parametrize("regime", ["perfect", "corrected", "balanced_corrected", "fpfnunsure", "fnunsure", "nonedge"])
def test_regimes_against_plain_replay(spark, regime):
    import random

    rnd = random.Random(11)
    rows = []
    for i in range(60):
        spam = rnd.random() < 0.3
        rows.append((0, i, i // 15, i, spam, sorted(rnd.sample("abcdefg" if spam else "efghijkl", rnd.randint(1, 5)))))
    m = spark.createDataFrame(rows, "fold long, seq long, grp long, msg_id long, is_spam boolean, tokens array<string>")
    o = EngineOptions()
    got = [(round(r.score, 6), r.guess, r.trained) for r in P.replay(m, regime, o).orderBy("msg_id").collect()]
    assert got == replay_by_hand([(g, s, t) for _, _, g, _, s, t in rows], regime, o)


def test_weak_decisions():
    o = EngineOptions()
    d = lambda name, s, spam: P.DECISIONS[name](s, spam, o)
    assert [d("unsureonly", s, True) for s in (0.1, 0.5, 0.95)] == [None, True, None]
    assert [d("unsureandfalses", s, False) for s in (0.1, 0.5, 0.95)] == [None, False, False]
    assert [d("allbut0and100", s, True) for s in (0.1, 0.996)] == [True, None]
    assert [d("owndecision", s, True) for s in (0.1, 0.5, 0.95)] == [False, None, True]
    assert [d("owndecision+fn", s, True) for s in (0.1, 0.5, 0.95)] == [True, True, True] and d("owndecision+fn", 0.95, False) is True


def test_bigram_tiling_against_greedy(spark):
    import random

    rnd = random.Random(3)
    probs = {t: rnd.choice([0.05, 0.2, 0.3, 0.45, 0.8, 0.99]) for t in [*"abcdef", *[f"bi:{x} {y}" for x in "abcdef" for y in "abcdef"]]}
    texts = [[rnd.choice("abcdef") for _ in range(rnd.randint(0, 12))] for _ in range(20)]
    m = spark.createDataFrame(list(enumerate(texts)), "msg_id long, tokens array<string>")
    got = {}
    for r in S.tile_bigrams(m, spark.createDataFrame(list(probs.items()), "token string, prob double")).orderBy("msg_id", "rank").collect():
        got.setdefault(r.msg_id, []).append(r.token)
    for i, t in enumerate(texts):
        at = {}
        for k, w in enumerate(t):
            at.setdefault(w, (k, k))
            if k:
                at.setdefault(f"bi:{t[k - 1]} {w}", (k - 1, k))
        used, want = set(), []
        for w in sorted((w for w in at if abs(probs[w] - 0.5) >= 0.1), key=lambda w: (abs(probs[w] - 0.5), probs[w], w), reverse=True):
            if not used & set(at[w]):
                used |= set(at[w])
                want.append(w)
        assert got.get(i, []) == want


def test_evidence_is_wrapped(spark):
    from tokensieve.operators import review as V

    parts = [f"'token{i}': 0.{i:02d}" for i in range(12)]
    r = spark.createDataFrame([(parts,)], "p array<string>").select(V.wrapped("X-Sieve-Evidence", F.col("p")).alias("w")).first()
    assert r.w.replace(";\n\t", "; ") == "; ".join(parts) and r.w.count(";\n\t") >= 2
    clues = spark.createDataFrame([([("*H*", 0.1), ("*S*", 0.9), ("it's", 0.01), ("plain", 0.4)],)], "c array<struct<token:string,prob:double>>")
    assert clues.select(V.shown_clues(F.col("c"), 0.3).alias("x")).first().x == ["'*H*': 0.10", "'*S*': 0.90", "\"it's\": 0.01"]
    marked = spark.createDataFrame([("spam,hello",), ("spam,spam,x",), ("hello",)], "t string")
    assert [r.x for r in marked.select(V.unnotate(F.col("t"), F.lit("spam")).alias("x")).collect()] == ["hello", "spam,x", "hello"]


def test_message_rules(spark):
    from tokensieve.functions import message as MSG

    one = spark.createDataFrame([(["ab@x.org", "abc@x.org"], ["solo@x.org"])], "a array<string>, b array<string>")
    r = one.select(MSG.recipient_summary(F.col("a")).alias("a"), MSG.recipient_summary(F.col("b")).alias("b")).first()
    assert r.a == ["pfxlen:0", "sfxlen:1"] and r.b == []
    lines = list(MSG.HABEAS.items())
    for heads, want in ((lines, ["x-habeas-swe:valid"]), (lines[:3], []), ([*lines[:8], ("x-habeas-swe-9", "wrong")], ["x-habeas-swe:invalid"])):
        h = spark.createDataFrame([(heads,)], "h array<struct<name:string,value:string>>")
        assert h.select(MSG.habeas_tokens(F.col("h"), reduce=True).alias("x")).first().x == want
    t = spark.createDataFrame([("QUJD\nRA==\nrest\n",), ("QUJDR\nx y\n",)], "t string").select(MSG.repair_base64(F.col("t")).alias("x")).collect()
    assert [r.x for r in t] == ["ABCDrest\n", "x y\n"]


def test_forms_and_exports(spark, tmp_path):
    files = spark.createDataFrame([("a", b"5\nhelloTRAILER")], "msg_id string, raw binary")
    assert bytes(mail.unwrap_emlx(files).first().raw) == b"hello"
    box = spark.createDataFrame([("From here on\nFrom a@b Mon Jan 1\n",)], "t string")
    assert box.select(mail.clean_mbox(F.col("t")).alias("x")).first().x == ">From here on\nFrom a@b Mon Jan 1\n"
    form = spark.createDataFrame([("v", 2)], "a string, b int").select(mail.form_message({"A": F.col("a"), "B": F.col("b")}).alias("x")).first().x
    assert form.startswith("X-Form-A: v\r\nX-Form-B: 2\r\n\r\n")
    store.write_corpus(spark.createDataFrame([("m1.txt", b"x"), ("m2.bin", b"y")], "msg_id string, raw binary"), str(tmp_path / "c"))
    assert [r.msg_id for r in store.read_corpus(spark, str(tmp_path / "c"), "*.txt").collect()] == ["m1.txt"]


def test_store_factory_and_conversion(spark, tmp_path):
    m = M.learn(msgs(spark, [("1", True, ["a", "b"]), ("2", False, ["b"])]))
    a, b = store.open_store(spark, str(tmp_path / "a")), store.open_store(spark, f"csv:{tmp_path}/b")
    with pytest.raises(FileNotFoundError):
        a.load()
    a.save(m)
    store.convert_store(a, b)
    assert isinstance(b, store.CsvStore) and info(b.load()) == info(m)
    assert store.probability_table(m, str(tmp_path / "p")).columns == ["token", "prob"]


def test_learning_counts_a_batch_once(spark, tmp_path):
    """A batch that comes again after a restart, with a new query and no memory of the old one, is left out."""
    from tokensieve.streaming import online

    st = store.ModelStore(spark, str(tmp_path / "model"))
    st.save(online.empty_model(spark))
    spark.createDataFrame([("1", "idiot clown", True, 1)], "msg_id string, text string, is_spam boolean, sign int").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("msg_id string, text string, is_spam boolean, sign int").parquet(str(tmp_path / "in"))
    for run in range(2):  # the second checkpoint knows nothing, so batch 0 comes again
        q = online.learn_stream(src, st, str(tmp_path / f"cp{run}"))
        q.processAllAvailable()
        q.stop()
    assert info(st.load())["idiot"] == (0, 1) and st.epoch() == 0
    skipped = []
    known = spark.createDataFrame([("1",)], "msg_id string")
    q = online.score_stream(src.select("msg_id", "text"), st, lambda df, e: skipped.extend(df.collect()), str(tmp_path / "cps"), lambda: known)
    q.processAllAvailable()
    q.stop()
    assert skipped == []
    sent = spark.createDataFrame([("1", "x", "Spam@here"), ("2", "y", "ham@here"), ("3", "z", "me@here")], "msg_id string, text string, rcpt string")
    assert {r.msg_id: r.is_spam for r in online.by_address(sent, "rcpt", "ham@here", "spam@here").collect()} == {"1": True, "2": False}


def test_mailbox_kinds(spark, tmp_path):
    for folder, name in (("md/cur", "1-2,S"), ("Mail/inbox", "7"), ("tree/sub", "a.txt"), ("tree/sub", "b.emlx")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_bytes(b"4\nA: bTRAIL" if name.endswith("emlx") else b"A: b")
    (tmp_path / "box").write_bytes(b"From a Mon Jan 1\nA: b\n")
    for path, kind, n in (("md", "maildir", 1), ("Mail/inbox", "mh", 1), ("tree", "files", 2), ("box", "mbox", 1)):
        assert mail.kind_of(spark, str(tmp_path / path)) == kind
        got = mail.read_messages(spark, str(tmp_path / path)).collect()
        assert len(got) == n and all(bytes(r.raw).strip() == b"A: b" for r in got)


def test_normal_quantile(spark):
    from tokensieve.functions.combine import norm_ip, norm_p

    r = spark.range(1).select(norm_ip(F.lit(0.975)).alias("z"), norm_p(norm_ip(F.lit(0.3))).alias("p")).first()
    assert abs(r.z - 1.96) < 1e-3 and abs(r.p - 0.3) < 1e-4


def test_tuning_never_costs_more(spark):
    import random

    rnd = random.Random(4)
    rows = [(str(i), i % 3 == 0, i % 2, [rnd.choice("abcdxyz" if i % 3 == 0 else "abcdefg") for _ in range(4)]) for i in range(24)]
    m = spark.createDataFrame(rows, "msg_id string, is_spam boolean, fold long, tokens array<string>")
    at, cost = P.tune(m, {"unknown_word_strength": 0.45}, 0.2, 2)
    first = E.total_cost(E.cross_validate(m), "flex", []).first()["cost"]
    assert at["unknown_word_strength"] > 0 and cost <= first


def test_message_info_store(spark, tmp_path):
    from tokensieve.operators import review as V

    st = store.MessageInfoStore(spark, str(tmp_path / "info"))
    assert st.load().count() == 0
    rows = lambda *r: spark.createDataFrame(r, "msg_id string, c string, t boolean")
    st.store(rows(("1", "h", None), ("2", "s", True)))
    st.store(rows(("2", "u", None), ("3", "s", False)))
    st.remove(rows(("1", "", None)))
    assert {r.msg_id: (r.c, r.t) for r in st.load().collect()} == {"2": ("u", None), "3": ("s", False)}
    both = V.message_state(rows(("3", "", None), ("9", "", None)).select("msg_id"), st.load())
    assert {r.msg_id: r.c for r in both.collect()} == {"3": "s", "9": None}


def test_labelled_messages(spark, tmp_path):
    for folder, n in (("ham", 5), ("spam", 3)):
        (tmp_path / folder).mkdir()
        for i in range(n):
            (tmp_path / folder / f"{i}.txt").write_bytes(b"A: b")
    paths = [str(tmp_path / "ham")], [str(tmp_path / "spam")]
    assert mail.labelled_messages(spark, *paths).count() == 8
    got = mail.labelled_messages(spark, *paths, keep=2, seed=3).groupBy("is_spam").count().collect()
    assert {r.is_spam: r["count"] for r in got} == {False: 2, True: 2}
