from tokensieve.llm import dac


def test_a_full_cache_keeps_what_it_met_first(monkeypatch):
    monkeypatch.setattr(dac, "CACHE", 40)
    enc = dac.PieceEncoder(dac.default_path())
    for i in range(4):
        texts = ["the of and", " ".join(f"word{chr(97 + i)}{chr(97 + j)} stop{chr(97 + j)}x?! été." for j in range(20)), "a.b.! _ ' x' ;; ß, Été!"]
        for t, x in zip(texts, enc.encode(texts), strict=True):
            assert list(memoryview(x).cast("I")) == enc.lib.encode(t, add_special_tokens=False).ids
    size = len(enc.known)
    assert size > 40
    first = list(enc.known)[:10]
    enc.encode(["again"])
    assert list(enc.known) == [*first, "again"]
