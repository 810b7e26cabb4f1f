import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from frameloom.llm import packing, queries
from tests.conftest import SMALL, rows


def optimum(sizes, cap):
    for n in range(1, len(sizes) + 1):
        for where in itertools.product(range(n), repeat=len(sizes)):
            fill = [0] * n
            for s, b in zip(sizes, where):
                fill[b] += s
            if max(fill) <= cap:
                return n
    return 0


def test_bound_and_packing_against_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        sizes = np.array([rnd.randint(1, 20) for _ in range(rnd.randint(1, 6))])
        best = optimum(sizes.tolist(), 20)
        assert packing.lower_bound(sizes, 20) <= best
        bins = packing.best_fit_decreasing(sizes, 20)
        assert np.bincount(bins, weights=sizes).max() <= 20 and bins.max() + 1 <= best + 1
    assert packing.lower_bound(np.array([11] * 7), 20) == 7
    assert packing.lower_bound(np.array([], dtype=int), 20) == 0 and len(packing.best_fit_decreasing(np.array([], dtype=int), 20)) == 0


def items(spark, sizes):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k long, n int")


def check(packed, sizes, cap):
    got = packed.collect()
    by = {}
    for r in got:
        by.setdefault(r.container_id, []).append(r)
    for rs in by.values():
        rs.sort(key=lambda r: r.place)
        assert [r.place for r in rs] == list(range(1, len(rs) + 1))
        at = 0
        for r in rs:
            assert r.start == at
            at += r.n
        assert at <= cap
    each = {}
    for r in got:
        each.setdefault(r.k, []).append(r.n)
    assert {k: sum(v) for k, v in each.items()} == {i: s or 0 for i, s in enumerate(sizes)}
    for k, v in each.items():
        assert len(v) == max(1, -(-(sizes[k] or 0) // cap))
    return len(by)


def test_everything_is_placed_once_within_the_capacity(spark):
    rnd = random.Random(2)
    sizes = [rnd.choice([0, 1, 5, 40, 60, 99, 100, 101, 250, 1000]) for _ in range(600)] + [None]
    used = check(packing.pack(items(spark, sizes), "k", "n", 100), sizes, 100)
    bound = -(-sum(s or 0 for s in sizes) // 100)
    assert used >= bound
    # Several partitions exchange what they can't fill.
    many = packing.pack(items(spark, sizes), "k", "n", 100, part_items=60)
    assert check(many, sizes, 100) <= used * 1.02
    rep = packing.report(many, "n", 100).first()
    assert rep.lower_bound <= rep.containers and rep.unused == rep.containers * 100 - rep.used


def test_only_empty_items_nothing_and_clashes(spark):
    df = items(spark, [0, None, 0])
    for c in ("key", "size", "part_no", "bin", "slot", "place"):
        df = df.withColumn(c, F.lit(7))
    check(packing.pack(df, "k", "n", 10), [0, None, 0], 10)
    assert packing.pack(df.limit(0), "k", "n", 10).count() == 0
    assert rows(packing.report(packing.pack(df.limit(0), "k", "n", 10), "n", 10)) == [(0, 0, 0, 0, 0)]


def test_documents(spark):
    got = queries.p8_containers(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert len({r.doc_id for r in got}) == docs
    rep = queries.p8_report(spark, SMALL).first()
    assert rep.containers <= rep.lower_bound + 1
