"""Operators 4 to 10 and the pipeline against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokensieve.llm import chaining, jaccard_join, mixing, near_vectors, sharding, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYL = ["the", "an", "er", "ou", "ti", "on", "ed", "re", "in", "st", "ble", "nd"]


def prose(rnd, n):
    return " ".join("".join(rnd.choice(SYL) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string, source string, n bigint, kid string"):
    return spark.createDataFrame(rows, schema)


def corpus(spark, seed=1):
    rnd = random.Random(seed)
    base = prose(rnd, 120)
    words = base.split()
    rows = [(i, prose(rnd, rnd.randint(1, 150)), f"s{i % 3}", 1, "x") for i in range(40)]
    rows += [(100 + i, base, "s0", 1, None) for i in range(12)]
    for i in range(25):
        w = list(words)
        for _ in range(rnd.randint(1, 3)):
            w[rnd.randrange(len(w))] = "edit%d" % rnd.randrange(9999)
        rows.append((200 + i, " ".join(w), "s0", 1, None))
    rows += [(300, None, None, 1, None), (301, "", None, 1, None), (302, " \n", "", 1, None), (303, "one", "s1", 1, None), (304, "ONE", "s1", 1, None), (305, "one", "s1", 1, None), (303, "one", "s1", 1, None), (306, "one two three", "s9", 1, None)]
    rows += [(400, "word " * 30_000, "s2", 1, None)]
    return frame(spark, rows)


def sets(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_components(rows):
    s = [sets(r.text) for r in rows]
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                par[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r.doc_id), r.doc_id)
    return sorted((r.doc_id, len(s[i]), low[find(i)] if s[i] else r.doc_id) for i, r in enumerate(rows))


def test_jaccard_components(spark):
    docs = corpus(spark)
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(docs.collect())
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_borderline(spark):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(60)] = f"e{rnd.randrange(5)}"
        rows.append((i, " ".join(w[: rnd.randint(50, 60)]), "s", 1, None))
    docs = frame(spark, rows)
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(docs.collect())


def test_jaccard_divided(spark, monkeypatch):
    """Regions are divided, blocks cut and sets sent in copies already at a few members."""
    for name, value in (("BLOCK", 4), ("PIVOTS", 2), ("SPREAD", 3), ("ALIKE", 8), ("OFTEN", 2), ("TURNS", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    rnd = random.Random(6)
    base = [[f"w{g}-{i}" for i in range(50)] for g in range(3)]
    rows = []
    for i in range(90):
        w = list(base[i % 3]) + base[0][:6]
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(50)] = f"e{rnd.randrange(40)}"
        rows.append((i, " ".join(w), "s", 1, None))
    docs = frame(spark, rows)
    got = jaccard_join.jaccard_components(docs).collect()
    want = brute_components(docs.collect())
    assert 3 < len({c for _, _, c in want}) < 60
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_jaccard_null_ids(spark):
    rows = [(None, "a b c d e f", "s", 1, None), (None, "a b c d e f", "s", 1, None), (7, "a b c d e f", "s", 1, None), (None, None, None, None, None)]
    got = jaccard_join.jaccard_components(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == [(7, 2, 7), (None, 0, None), (None, 2, 7), (None, 2, 7)]


def test_keep_one_clashing_names(spark):
    docs = corpus(spark).select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(["row", "row_key", "_id", "_keep", "_n", "component", "kid", "h"])])
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} == {tuple(range(8))}


def test_keep_one(spark):
    docs = corpus(spark)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    comp = brute_components(docs.collect())
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in comp})


def test_keep_one_null_and_repeated_ids(spark):
    rnd = random.Random(24)
    a, b, c, d = (prose(rnd, 40) for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (None, b), (2, c), (2, d), (3, d), (None, ""), (4, None)]
    kept = jaccard_join.keep_one(frame(spark, [(i, t, "s", 1, None) for i, t in rows])).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, a), (None, b), (2, c), (2, d), (None, ""), (4, None)], key=str)


def test_simhash(spark):
    docs = frame(spark, [(r.doc_id, r.text, r.source, 1, None) for r in corpus(spark).collect() if r.doc_id != 303])
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = simhash.with_neighbour(docs).where("_ghost = 0").collect()
    nxt = {r.doc_id: (rows[(i + 1) % len(rows)].text or "") for i, r in enumerate(rows)}
    assert {r.doc_id: r.next_text for r in got} == nxt
    p = simhash.fingerprints(docs, ["doc_id"], "text")
    by_text = {}
    text = {r.doc_id: r.text or "" for r in rows}
    for r in p.collect():
        by_text.setdefault(text[r.doc_id], set()).add((r.hi, r.lo))
    assert all(len(v) == 1 for v in by_text.values()) and p.count() == len(rows)
    pairs, members = simhash.near_pairs(p, 6)
    fp = sorted({(r.hi, r.lo) for r in p.collect()})
    mask = (1 << 64) - 1
    want = {(a, b) for i, a in enumerate(fp) for b in fp[i + 1 :] if (((a[0] ^ b[0]) & mask).bit_count() + ((a[1] ^ b[1]) & mask).bit_count()) <= 6}
    assert {((r.hi, r.lo), (r.hi2, r.lo2)) for r in pairs.collect()} == want and members.count() == len(rows)
    assert simhash.with_neighbour(docs.limit(0)).count() == 0


def test_simhash_ranges_with_repeats(spark):
    docs = frame(spark, [(i // 2, f"t{i}", "s", 1, None) for i in range(600)] + [(None, "none", "s", 1, None)])
    got = {(r.doc_id, r.text): r.next_text for r in simhash.with_neighbour(docs).where("_ghost = 0").collect()}
    order = sorted(((-1 if r.doc_id is None else r.doc_id), r.text, r.doc_id) for r in docs.collect())
    for i, (_, t, d) in enumerate(order):
        if d is not None or i:
            assert got[(d, t)] == order[i - 1][1]
    assert len(got) == 601


def test_passages(spark):
    rnd = random.Random(9)
    p = [prose(rnd, 70) for _ in range(3)]
    fuzzy = p[2].split()
    fuzzy[20:21] = ["zzz", "yyy"]
    del fuzzy[45]
    rows = [(i, f"{prose(rnd, 30)} {p[0]} {prose(rnd, 40)}", "s", 1, None) for i in range(20)]
    rows += [(50 + i, f"{prose(rnd, 90)} {p[1]}", "s", 1, None) for i in range(3)]
    rows += [(60, f"{p[2]} {prose(rnd, 50)}", "s", 1, None), (61, f"{prose(rnd, 25)} {' '.join(fuzzy)} {prose(rnd, 25)}", "s", 1, None)]
    rows += [(70 + i, prose(rnd, 200), "s", 1, None) for i in range(10)] + [(90, None, None, 1, None), (91, "", "s", 1, None), (92, "short", "s", 1, None)]
    docs = frame(spark, rows)
    got = chaining.passages(docs).collect()
    found = {r.doc_id: r for r in got}
    assert set(found) == {*range(1, 20), 51, 52, 61}
    assert all(found[i].source_doc_id == 0 and abs(found[i].start - 30) <= 3 and abs(found[i].end - 100) <= 3 for i in range(1, 20))
    assert found[61].source_doc_id == 60 and abs(found[61].end - found[61].start - 70) <= 2 and found[61].equal >= 66
    left = {r.doc_id: r for r in chaining.remove_passages(docs).collect()}
    assert left[0].text == rows[0][1] and p[0] not in left[5].text and left[5].text.split()[:27] == rows[5][1].split()[:27]
    assert left[90].text is None and left[70].text == rows[25][1] and len(left) == len(rows)
    assert chaining.passages(docs.limit(0)).count() == 0
    twice = chaining.remove_passages(docs.where("doc_id < 2").unionByName(docs.where("doc_id < 2")))
    assert twice.count() == 4


def test_passages_with_many_edits(spark):
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(40):
        p = rnd.choices(words, k=60)
        q = [f"e{rnd.random()}" if k % (5, 6, 7, 8)[i % 4] == 4 and k < 59 else w for k, w in enumerate(p)]
        rows += [(2 * i + k, " ".join(rnd.choices(words, k=40) + x + rnd.choices(words, k=40)), "s", 1, None) for k, x in enumerate((p, q))]
    got = chaining.passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} == {(2 * i + 1, 2 * i) for i in range(40)}
    assert all(r.end - r.start >= 50 and r.equal >= 0.8 * (r.end - r.start) for r in got)


def test_passages_copied_several_times(spark):
    rnd = random.Random(22)
    words = [f"w{i}" for i in range(5000)]
    p = rnd.choices(words, k=55)
    rows = [(1, " ".join(p + rnd.choices(words, k=30)), "s", 1, None), (2, " ".join(sum((rnd.choices(words, k=9) + p for _ in range(13)), [])), "s", 1, None)]
    rows += [(3, "again " * 400, "s", 1, None), (4, "again " * 300, "s", 1, None)]
    docs = frame(spark, rows)
    got = [r for r in chaining.passages(docs).collect() if r.doc_id == 2]
    assert {x for r in got for x in range(r.start, r.end)} >= {64 * k + 9 + x for k in range(13) for x in range(55)}
    left = {r.doc_id: r.text for r in chaining.remove_passages(docs).collect()}
    assert left[1] == rows[0][1] and len(left[2].split()) <= 13 * 9 and len(left[4].split()) < 50


def test_passages_with_parts_seen_before(spark):
    rnd = random.Random(23)
    words = [f"w{i}" for i in range(5000)]
    x, y, z = (rnd.choices(words, k=20) for _ in range(3))
    around = [(rnd.choices(words, k=30), rnd.choices(words, k=30)) for _ in range(4)]
    rows = [(i + 1, " ".join(a + p + b), "s", 1, None) for i, (p, (a, b)) in enumerate(zip((x + y, y + z, x + y + z, x + y + z), around, strict=True))]
    got = chaining.passages(frame(spark, rows)).collect()
    assert [(r.doc_id, r.source_doc_id, r.start, r.end, r.equal) for r in got] == [(4, 3, 30, 90, 60)]


@pytest.mark.parametrize("crowd", [1024, 4])
def test_passages_whose_lines_were_met_elsewhere(spark, monkeypatch, crowd):
    """Three lines, first met one by one in many texts, stand together with edits in and between them in two later texts."""
    monkeypatch.setattr(chaining, "CROWD", crowd)
    monkeypatch.setattr(chaining, "BLOCK", 8)
    rnd = random.Random(24)
    words = [f"w{i}" for i in range(5000)]
    lines = [rnd.choices(words, k=19) for _ in range(3)]
    rows = [(i, " ".join(rnd.choices(words, k=20) + lines[i % 3] + rnd.choices(words, k=20)), "s", 1, None) for i in range(30)]
    rows += [(i, " ".join(rnd.choices(words, k=30) + sum(([f"e{rnd.random()}", *x[:k], f"e{rnd.random()}", *x[k + 1 :]] for x in lines), []) + rnd.choices(words, k=30)), "s", 1, None) for i, k in ((50, 3), (51, 15))]
    got = chaining.passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} == {(51, 50)}
    assert min(r.start for r in got) == 35 and max(r.end for r in got) == 86


def test_chain_prefers_order():
    pos, other = np.array([0, 5, 10, 12, 20]), np.array([100, 105, 3, 112, 120])
    assert chaining.chain(pos, other)[0] == [0, 1, 3, 4]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((200, 16))
    rows = [(i, x.astype(float).tolist(), 1) for i, x in enumerate(v)]
    rows += [(300 + i, (v[i % 4] + rng.standard_normal(16) * 0.18).tolist(), 1) for i in range(120)]
    rows += [(500 + i, v[7].tolist(), 1) for i in range(300)] + [(900, (v[7] * 3).tolist(), 1)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [], 1), (1004, [1.0, 2.0], 1), (1005, [None] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in near_vectors.near_vectors(df).collect()}
    ok = [(i, np.array(x) / np.linalg.norm(x)) for i, x, _ in rows if x and None not in x and np.isfinite(x).all() and np.linalg.norm(x) > 0 and len(x) == 16]
    m = np.stack([x for _, x in ok])
    cos = m @ m.T
    link = cos >= 0.95
    want = {i: int(link[k].sum()) - 1 for k, (i, _) in enumerate(ok)}
    have, need = sum(got[i].n_links for i in want), sum(want.values())
    assert len(got) == len(rows) and have >= 0.98 * need and all(got[i].n_links <= n for i, n in want.items())
    assert got[900].component_id == 7 and got[7].kept and not got[900].kept
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1000, 1006))
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_mixing(spark):
    docs = corpus(spark)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda rows: sorted((r.doc_id, r.mix_copies) for r in rows)
    assert key(got) == key(again) and len(got) == docs.count()
    size = {}
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + len(WORD.findall(r.text or ""))
    order = sorted(size, key=lambda x: (x is None, (x or "").encode()))
    weight = {k: [5, 2, 1][i % 3] for i, k in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while True:
        w = sum(weight[k] for k in open_)
        over = {k for k in open_ if left * weight[k] / w >= 2 * size[k]}
        if not over:
            target |= {k: left * weight[k] / w for k in open_}
            break
        target |= {k: 2.0 * size[k] for k in over}
        left -= sum(2.0 * size[k] for k in over)
        open_ -= over
        if not open_:
            break
    taken = {}
    for r in got:
        assert r.mix_copies in (0, 1, 2) and abs(r.mix_target - target[r.source]) < 1e-6 and r.mix_source_size == size[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.mix_copies * r.mix_size
    assert all(abs(taken[k] - t) <= max(40, 0.1 * t) for k, t in target.items() if size[k] < 20_000)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_toxicity(spark):
    rnd = random.Random(5)
    bad = ["idiot", "moron", "scumbag"]
    rows, labels = [], []
    for i in range(400):
        w = prose(rnd, rnd.randint(20, 60)).split()
        toxic = i % 5 == 0
        if toxic:
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        rows.append((i, " ".join(w), "s", 1, None))
        labels.append((i, int(toxic)))
    docs = frame(spark, rows)
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, lab, learn=~toxicity.held_out())
    scored = toxicity.score(docs, model, "score").withColumn("h", toxicity.held_out()).collect()
    import zlib

    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    test = [(r.score, r.doc_id % 5 == 0) for r in scored if r.h]
    assert all((s >= toxicity.THRESHOLD) == t for s, t in test)
    clean = prose(rnd, 30)
    odd = frame(spark, [(1, clean + " i.d.i.o.t", "s", 1, None), (2, clean + " i d i o t", "s", 1, None), (3, clean + " idi-ot", "s", 1, None), (4, clean, "s", 1, None), (5, None, "s", 1, None), (6, "", None, 1, None)])
    s = {r.doc_id: r.toxicity for r in toxicity.score(odd, model).collect()}
    assert min(s[1], s[2], s[3]) >= toxicity.THRESHOLD > max(s[4], s[5], s[6]) and s[5] == s[6]
    none = toxicity.train(docs, lab.limit(0))
    assert toxicity.score(docs, none).where("toxicity BETWEEN 0 AND 1").count() == 400


def test_toxicity_edges(spark):
    """Empty tables, repeated rows, null ids, very long texts and clashing names."""
    rnd = random.Random(15)
    rows = [(i, prose(rnd, 30) + (" idiot" if i % 3 == 0 else ""), "s", 1, None) for i in range(120)]
    docs = frame(spark, rows)
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.train(docs, lab)
    assert toxicity.score(docs.limit(0), model).count() == 0
    unknown = toxicity.train(docs.limit(0), lab.limit(0))
    assert all(r.toxicity < 1e-9 for r in toxicity.score(docs, unknown).collect())
    long = prose(rnd, 60_000)
    odd = frame(spark, [(1, long, "s", 1, None), (2, long + " idiot", "s", 1, None), (2, long + " idiot", "s", 1, None), (None, "idiot", None, None, None)])
    for c in ("words", "known", "out", "label"):
        odd = odd.withColumn(c, F.lit(c))
    out = toxicity.score(odd, model)
    assert out.columns == [*odd.columns, "toxicity"]
    got = sorted(((str(r.doc_id), r.toxicity >= toxicity.THRESHOLD, r.words) for r in out.collect()))
    assert got == [("1", False, "words"), ("2", True, "words"), ("2", True, "words"), ("None", True, "words")]


def test_vectors_with_null_and_repeated_ids(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    w = [4.0, -3.0, 2.0, -1.0]
    rows = [(None, v), (None, v), (1, v), (2, v), (2, v), (3, w), (4, [2.0, 4.0, 6.0, 8.0]), (None, None)]
    df = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<double>, n_links string")
    got = sorted(((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_vectors.near_vectors(df).collect()))
    assert got == [("1", 3, "1", True), ("2", 3, "1", False), ("2", 3, "1", False), ("3", 0, "3", True), ("4", 3, "1", False), *[("None", 0, "None", True)] * 3]


def test_sharding(spark, tmp_path):
    docs = corpus(spark)
    st = sharding.shard_documents(docs, f"file://{tmp_path}/s", arrivals=3, target=1 << 20)
    m = st.manifest()
    assert m["version"] > 3 and len(m["shards"]) < 8
    key = lambda rows: sorted((str(r.doc_id), str(r.text), str(r.source), str(r.kid)) for r in rows)
    assert key(st.read().collect()) == key(docs.collect())
    old = st.read(1).count()
    assert 0 < old < docs.count()
    st.append(docs.limit(5))
    assert st.read().count() == docs.count() + 5
    with pytest.raises(sharding.Conflict):
        st.commit([], None, st.version() - 1)
    assert st.vacuum() > 0 and st.read().count() == docs.count() + 5


def test_sharding_lost_writer(spark, tmp_path):
    docs = corpus(spark).limit(20).withColumn("_shard", F.lit("mine"))
    st = sharding.Store(spark, f"file://{tmp_path}/s", lease=1.0)
    st.append(docs)
    (tmp_path / "s" / "manifest" / "_claim-0000000002").touch()  # a writer lost between its claim and the manifest
    assert st.append(docs) == 2
    rows = st.read()
    assert rows.count() == 40 and {r._shard for r in rows.collect()} == {"mine"} and "_shard_" in rows.columns
    empty = sharding.shard_documents(docs.limit(0), f"file://{tmp_path}/e", arrivals=2)
    assert empty.read().count() == 0


def test_caps_memory_is_bounded():
    import tracemalloc

    tracemalloc.start()
    caps = near_vectors.Caps(32, 10_000_000)
    assert caps.words > 2000 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_mixing_clashes_and_ties(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 4)
    rows = [(i, "a b c d e", "s", 1, "x") for i in range(200)] + [(7, "a b c d e", "s", 1, "x")] * 61 + [(None, "one two", None, 1, None)] * 3 + [(i, "f " * (i % 7), "t", 1, "y") for i in range(90)]
    docs = frame(spark, rows)
    for i, c in enumerate(["_h", "_n", "_k", "_before", "_part", "_skey", "h", "skey", "words", "n", "size", "salt", "base"]):
        docs = docs.drop(c).withColumn(c, F.lit(i))
    got = mixing.mix(docs)
    assert got.columns == docs.columns + mixing.ADDED
    got = got.collect()
    assert len(got) == len(rows) and {tuple(r)[4:-4] for r in got} == {tuple(range(13))}
    for s in ("s", None, "t"):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.mix_copies * r.mix_size for r in mine) - mine[0].mix_target) <= 5 and max(r.mix_copies for r in mine) <= 2


def test_remove_passages_clashes_and_hashed_column(spark):
    rnd = random.Random(31)
    p = prose(rnd, 80)
    rows = [(i, f"{prose(rnd, 30)} {p} {prose(rnd, 20 * i)}", "s", 1, None) for i in range(1, 4)] + [(None, p, "s", 1, None)]
    docs = frame(spark, rows)
    for c in ("_id", "_spans", "id", "spans"):
        docs = docs.withColumn(c, F.xxhash64("text"))
    for part in (docs.where("doc_id IS NOT NULL"), docs):
        left = chaining.remove_passages(part)
        assert left.columns == docs.columns
        assert sorted(p in (r.text or "") for r in left.collect()) == [False] * (part.count() - 1) + [True]
    long = frame(spark, [(1, prose(rnd, 3000), "s", 1, None), (2, " ".join([prose(rnd, 40_000), p, prose(rnd, 40_000)]), "s", 1, None), (3, p, "s", 1, None)])
    assert [(r.doc_id, r.source_doc_id) for r in chaining.passages(long).collect()] == [(3, 2)]


def test_pipeline_small(spark, tmp_path):
    import corpus_pipeline as cp

    docs = corpus(spark).select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(now.count())
    assert counts[0] == docs.count() and counts[1] == len({c for _, _, c in brute_components(docs.collect())})
    last = cp.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    want = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in now.collect())
    assert sorted(r.decoded_sha256 for r in last) == want
