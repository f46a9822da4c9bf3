"""Pairs that share several buckets are listed once, and none is left out."""

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from linkora.llm.graph import open_in_buckets


def test_pairs_of_many_buckets_are_listed_once(spark):
    rng = random.Random(4)
    comp = {i: rng.randrange(8) for i in range(60)}
    buckets = {key: rng.sample(range(60), 25) for key in range(12)}
    rows = []
    for key, ids in buckets.items():
        main = max(Counter(comp[i] for i in ids).items(), key=lambda x: (x[1], x[0]))[0]
        rows += [(key, i, comp[i], main, 0) for i in ids]
    rest = spark.createDataFrame(rows, "key long, id long, comp int, main int, cls int")
    want = {p for ids in buckets.values() for p in combinations(sorted(ids), 2) if comp[p[0]] != comp[p[1]]}
    some = lambda x, y: (F.col(f"{x}id") + F.col(f"{y}id")) % 3 != 0
    for kinds in (1, 2):
        got = [tuple(r) for r in open_in_buckets(rest, [], some, False, F.col("key") % kinds).collect()]
        assert set(got) == {p for p in want if sum(p) % 3}
        assert max(Counter(got).values()) <= kinds
    assert {tuple(r) for r in open_in_buckets(rest, [], some, False, None).collect()} == set(got)
