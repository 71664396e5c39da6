"""Hashed vectors and exact nearest neighbours: published hash values, brute force, ties, nulls and empty tables."""

import random

from pyspark.sql import functions as F

from mnemospark.functions import text
from mnemospark.operators import search


def fnv(token):
    h = 0x811C9DC5
    for c in token:
        h = ((h ^ ord(c)) * 0x01000193) % 2**32
    return h


def test_hashed_vector(spark):
    assert fnv("a") == 0xE40C292C  # from the published table
    df = spark.createDataFrame([(1, "Cache cache 缓存键 x"), (2, None), (3, ""), (4, "word " * 20_000)], "k int, t string")
    got = {r.k: r.v for r in df.select("k", text.hashed_vector(F.col("t")).alias("v")).collect()}
    want = [0.0] * 256
    for token, weight in (("cache", 2), ("x", 1), ("缓存", 0.5), ("存键", 0.5)):
        want[fnv(token) % 256] += weight
    assert list(got[1]) == want and sum(got[2]) == sum(got[3]) == 0 and got[4][fnv("word") % 256] == 20_000


def test_nearest_against_brute_force(spark):
    draw = random.Random(2)
    vectors = [(k, [draw.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for k in range(300)]
    vectors += [(k, vectors[0][1]) for k in range(300, 360)] + [(5, vectors[5][1]), (7, [1.0, 1.0, 1.0, 1.0]), (400, None), (None, [1.0] * 4), (401, [1.0, 2.0]), (402, [])]
    queries = [(k, vectors[k][1]) for k in range(0, 300, 20)] + [(400, None), (401, [1.0, 2.0]), (402, [])]

    def cosine(a, b):
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / size, 9) if size else 0.0

    want = []
    for q, a in queries:
        best = {}
        for d, b in vectors:
            if d is not None and d != q and a and b and len(a) == len(b):
                best[d] = max(best.get(d, -2), cosine(a, b))
        want += [(q, d, r) for r, (s, d) in enumerate(sorted((-s, d) for d, s in best.items() if s >= -0.5)[:6], 1)]
    v = spark.createDataFrame(vectors, "doc_id long, v array<double>").withColumn("label", F.lit(1)).repartition(5)
    q = spark.createDataFrame(queries, "query_id long, v array<double>").withColumn("label", F.lit(2))
    for block in (5_000, 4):
        got = search.nearest(v, q, 6, -0.5, block=block)
        assert sorted((r.query_id, r.doc_id, r["rank"]) for r in got.collect()) == sorted(want)
    assert search.nearest(v.limit(0), q, 3).count() == 0 and search.nearest(v, q.limit(0), 3).count() == 0
