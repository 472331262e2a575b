"""The search for past moments against all pairs, its work, and samples by hash counts."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.operators import analogues, memories, neighbours, sampling
from panelworks.operators.analogues import Cuts, Sizes, nearest

SMALL = Sizes(cell=40, cells=16, part=30, sample=200, block=16, sessions=20, leaf=4)


def plain(z, sidx, turn, hashed, q, cut, limit, k):
    d = np.round(np.sqrt(((q - z) ** 2).sum(1)), 9)
    use = np.flatnonzero((sidx <= cut) & (hashed <= limit))
    return use[np.lexsort((turn[use], d[use]))][:k]


@pytest.mark.parametrize("dims", [1, 2, 10])
def test_leaves_give_what_all_distances_give(dims):
    rng = np.random.default_rng(dims)
    z = np.round(rng.random((500, dims)) * (8 if dims < 3 else 1)) if dims < 3 else rng.random((500, dims))  # many ties
    sidx, hashed = rng.integers(0, 60, 500), rng.integers(0, 9, 500)
    turn = np.lexsort((np.arange(500), sidx)).argsort()
    q, cut, limit = rng.random((70, dims)) * 8, rng.integers(-3, 70, 70), rng.integers(3, 12, 70)
    far, row = nearest(z, sidx, turn, hashed, q, cut, limit, np.full(70, np.inf), 7, 4)
    for i in range(70):
        want = plain(z, sidx, turn, hashed, q[i], cut[i], limit[i], 7)
        assert row[i][row[i] >= 0].tolist() == want.tolist() and np.isfinite(far[i]).sum() == len(want)


def test_a_symbols_own_search_computes_few_distances():
    rng = np.random.default_rng(4)
    z, sidx, computed = rng.random((2_000, 2)), np.arange(2_000), []
    cut = np.arange(2_000) // 20 * 20 - 6
    nearest(z, sidx, sidx, np.zeros(2_000, int), z, cut, np.zeros(2_000, int), np.full(2_000, np.inf), 20, 16, computed)
    assert sum(computed) < 0.2 * np.maximum(cut + 1, 0).sum()


def test_cuts_deal_evenly_and_place_alike():
    z = np.random.default_rng(5).random((4_096, 3))
    cuts = Cuts(z, 4)
    sizes = np.bincount(cuts.place(z), minlength=16)
    assert sizes.min() == sizes.max() == 256 and Cuts(np.zeros((0, 2)), 2).place(np.ones((3, 2))).tolist() == [3, 3, 3]


@pytest.fixture(scope="module")
def panel():
    rng = random.Random(6)
    day = dt.date(2021, 1, 1)
    rows = []
    for s in range(110):
        for w in "abcd":
            if rng.random() < 0.9:
                y = rng.random() if rng.random() < 0.9 else None
                rows.append((w, day + dt.timedelta(days=2 * s), s, rng.randint(0, 6) / 6, rng.random() if rng.random() < 0.97 else None, *[y] * 5))
    return rows


@pytest.fixture(scope="module")
def rows(spark, panel):
    return spark.createDataFrame(panel, "symbol string, ts date, sidx int, za double, zb double, " + ", ".join(f"{o} double" for o in memories.OUTCOMES)).repartition(3)


def wanted(panel, k, least_pool, cap=None):
    """{(symbol, ts): mem_cross_ret} by all pairs."""
    known = [r for r in panel if r[4] is not None]
    first, out = {}, {}
    for r in known:
        first[r[1].month] = min(first.get(r[1].month, 10**9), r[2])
    for r in known:
        cut = first[r[1].month] - 6
        pool = [p for p in known if p[5] is not None and p[2] <= cut]
        if len(pool) < least_pool or not any(x[2] == cut for x in known):
            continue
        if cap is not None:
            pool = sorted(pool, key=lambda p: hashlib.md5(f"{p[0]}/{p[1]}".encode()).hexdigest()[:15])[:cap]
        near = sorted((round(float(np.hypot(r[3] - p[3], r[4] - p[4])), 9), p[2], p[0], p[5]) for p in pool)[:k]
        w = [1 / (d + 0.1) for d, *_ in near]
        out[r[0], r[1]] = sum(a * x[3] for a, x in zip(w, near, strict=True)) / sum(w)
    return out


@pytest.mark.parametrize("cap", [None, 60])
def test_memory_over_many_cells(rows, panel, cap):
    got = memories.memory(rows, ["za", "zb"], k_cross=9, k_self=4, least_self=5, least_pool=70, pool_cap=cap, block=16, sizes=SMALL)
    got = {(r["symbol"], r["ts"]): r["mem_cross_ret"] for r in got.collect()}
    want = wanted(panel, 9, 70, cap)
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_own_history_in_stretches(rows, panel):
    got = {(r["symbol"], r["ts"]): (r["n"], r["mean"]) for r in neighbours.knn_self(rows, ["za", "zb"], "ret", 5, least=10, sizes=SMALL).collect()}
    known = [r for r in panel if r[4] is not None]
    first = {}
    for r in panel:
        first[r[1].month] = min(first.get(r[1].month, 10**9), r[2])
    want = {}
    for r in known:
        own = sorted((round(float(np.hypot(r[3] - p[3], r[4] - p[4])), 9), p[2], p[5]) for p in known if p[0] == r[0] and p[5] is not None and p[2] <= first[r[1].month] - 6)
        if len(own) >= 10:
            w = [1 / (d + 0.1) for d, *_ in own[:5]]
            want[r[0], r[1]] = len(own), sum(a * x[2] for a, x in zip(w, own, strict=False)) / sum(w)
    assert got.keys() == want.keys() and all(got[k] == (want[k][0], pytest.approx(want[k][1], abs=1e-9)) for k in want)


def test_plans_hold_no_nested_loop(rows):
    seen = []
    kept = analogues.durable

    def watched(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    for module in (analogues, memories):
        module.durable = watched
    try:
        out = memories.memory(rows, ["za", "zb"], least_pool=70, pool_cap=60, sizes=SMALL)
    finally:
        for module in (analogues, memories):
            module.durable = kept
    seen.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(seen) > 4 and not any("NestedLoop" in p or "CartesianProduct" in p for p in seen)


def test_limits_by_counts_are_those_of_a_sort(spark):
    rng = random.Random(7)
    rows = [(rng.choice([rng.getrandbits(60), rng.getrandbits(60) >> 40, 5]), rng.randint(0, 4)) for _ in range(900)]
    df = spark.createDataFrame(rows, "h long, g int")
    for cap in (1, 40, 300, 5_000):
        limits = sampling.hash_limits(df, "h", "g", 5, cap)
        for g, limit in enumerate(limits):
            pool = sorted(h for h, e in rows if e <= g)
            at_or_below = [h for h in pool if h <= limit]
            assert at_or_below == [h for h in pool if h <= (pool[cap - 1] if len(pool) > cap else pool[-1])]


def test_capped_sample_is_that_of_a_sort_without_one_partition(spark):
    df = spark.range(5_000).select((F.col("id") % 4_000).alias("key"), F.lit("x").alias("other"))
    text = lambda k: hashlib.md5(f"{k}:7".encode()).hexdigest()
    keys = [k % 4_000 for k in range(5_000)]
    for cap in (1, 77, 4_999, 5_000, 9_000):
        got = sampling.capped_sample(df, "key", cap)
        assert sorted(r.key for r in got.collect()) == sorted(sorted(keys, key=lambda k: (text(k), k))[:cap])
    plan = sampling.capped_sample(spark.range(5_000).withColumnRenamed("id", "key"), "key", 77)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "TakeOrdered" not in plan
