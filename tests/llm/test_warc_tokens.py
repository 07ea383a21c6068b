"""Operators 1 to 3 against plain brute force."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokensieve.llm import bpe_automaton, dac, warc

TEXTS = ["", None, "Hello  world", "a" * 70_000, "foo\n\n bar  ", "it's <|endoftext|> 1234", "日本語 🙂🙂 é", "x\x1cy \x85 z", "same", "same"]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (3, "again", None)]
    return table(spark, rows, "doc_id long, text string, ids string")


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe_automaton.default_path())
    c = bpe_automaton.codec(bpe_automaton.default_path())
    rnd = random.Random(3)
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice("aabcde theinr \n\t.,'s129éñ—") for _ in range(60)) for _ in range(800)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert c.encode(t) == ",".join(map(str, ids))
        assert c.decode(c.encode(t)) == lib.decode(ids, skip_special_tokens=False) == t
    docs = documents(spark)
    got = bpe_automaton.encode_documents(docs).collect()
    assert len(got) == 12
    want = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect())
    assert sorted(r.decoded_sha256 for r in got) == want
    back = bpe_automaton.decode_documents(bpe_automaton.encode_documents(docs)).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in docs.collect())
    assert bpe_automaton.encode_documents(docs.limit(0)).count() == 0


def test_automaton_is_bpe_on_small_merge_lists():
    def plain(word, ranks):
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks), default=None)
            if best is None:
                return parts
            pair = parts[best[1]], parts[best[1] + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out

    rnd = random.Random(5)
    for _ in range(60):
        known, merges = [b"a", b"b", b"c"], []
        for _ in range(rnd.randint(1, 12)):
            u, v = rnd.choice(known), rnd.choice(known)
            if (u, v) not in merges and u + v not in known:
                merges.append((u, v))
                known.append(u + v)
        vocab = {t: i for i, t in enumerate(known)}
        m = bpe_automaton.MergeAutomaton(vocab, merges)
        ranks = {p: i for i, p in enumerate(merges)}
        for _ in range(60):
            w = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 14)))
            assert [m.labels[i] for i in m.encode(w)] == plain(w, ranks)


def test_dac_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for width in (4, 8, 13):
        for n in (0, 1, 511, 512, 5000):
            ids = rng.integers(0, 1 << rng.integers(1, 32), n, dtype=np.uint64).astype(np.uint32)
            s = dac.Shard(dac.dump([1, None], [n // 3, n - n // 3], ids, width))
            assert (s.slice(0, n) == ids).all() and s.doc_ids == [1, None]
            for k in rng.integers(0, max(n, 1), 40):
                if n:
                    assert s.token(int(k)) == ids[k]
                    assert (s.slice(int(k), min(n, int(k) + 77)) == ids[k : k + 77]).all()
    with pytest.raises(IndexError):
        s.token(5000)


def test_token_files(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(dac.default_path())
    docs = documents(spark)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, want = 0, []
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = dac.read_tokens(dac.write_tokens(docs, shard_tokens=50)).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    assert dac.read_tokens(dac.write_tokens(docs.limit(0))).count() == 0


def test_warc_round_trip(spark):
    big = "x" * 200_000
    rows = [(1, "http://a/\n", big, 1), (2, None, big, 1), (3, "u", None, 1), (4, "u", "", 1), (5, "u", "é" * 700, 1), (None, "u", "é" * 700, 1), (5, "u", "é" * 700, 1), (6, "u", "tiny", 1), (7, "u", "tiny", 1)]
    pages = table(spark, rows, "page_id long, url string, html string, payload_digest int")
    manifest = warc.write_warc(warc.plan_records(pages))
    got = warc.read_chunks(spark, manifest, chunk=1000).collect()
    whole = {}
    for r in sorted(got, key=lambda r: r.chunk_no):
        k = (r.record_id, r.record_type)
        if r.chunk_no == 0:
            whole.setdefault(k, []).append(b"")
        whole[k][-1] += bytes(r.data)
        if len(whole[k]) == 1:
            assert r.digest_so_far == hashlib.sha1(whole[k][-1]).hexdigest() and r.bytes_so_far == len(whole[k][-1])
    last = {(r.record_id, r.record_type, r.refers_to) for r in got if r.is_last}
    name = lambda i: f"<urn:tokensieve:page:{i}>"
    assert last == {(name(1), "revisit", name(2)), (name(2), "response", None), (name(""), "revisit", name(5)), *((name(i), "response", None) for i in (3, 4, 5, 6, 7))}
    assert sum(r.is_last for r in got) == 9
    assert warc.read_chunks(spark, warc.write_warc(warc.plan_records(pages.limit(0)))).count() == 0


def test_warc_reader_streams():
    recs = [{"record_type": "response", "page_id": i, "url": None, "payload_digest": "", "payload_bytes": n} for i, n in enumerate((0, 10, 99_999))]
    raw = b""
    for r in recs:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        raw += z.compress(warc._header(r) + b"z" * r["payload_bytes"] + b"\r\n\r\n") + z.flush()
    rows = list(warc.chunks(io.BytesIO(raw), 4096))
    assert [r["bytes_so_far"] for r in rows if r["is_last"]] == [0, 10, 99_999] and max(len(r["data"]) for r in rows) == 4096
