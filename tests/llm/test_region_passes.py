from pyspark.sql import functions as F

from tokensieve.llm import jaccard_join as J


def test_regions_are_made_in_parts_and_lose_none(spark):
    rows = [(k, 10 + k % 3, [k // 2, -(k // 3), 1000 + k, 7], k % 2) for k in range(1, 60)]
    sets = spark.createDataFrame(rows, "kid long, n long, first array<long>, hot int").coalesce(1)
    parts = J.first_regions(sets)
    cold = parts[:-1]
    assert len(cold) == J.PASSES > 1
    for i, part in enumerate(cold):
        assert all(r.h % J.PASSES == i for r in part.collect())
    got = sorted((r.h, r.kid, r.n, r.pivot, r.pivot_n) for p in parts for r in p.collect())
    want = set()
    for kind in (0, 1):  # shingles that are hot and those that are not
        held: dict[int, set] = {}
        for kid, n, first, hot in rows:
            for h in first[4 - hot :] if kind else first[: 4 - hot]:
                held.setdefault(h, set()).add((n, kid))
        want |= {(h, kid, n, min(m)[1], min(m)[0]) for h, m in held.items() if len(m) > 1 for n, kid in m}
    assert got == sorted(want)
