"""Records and memories against plain Python, the second stage against leaks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelworks.operators import memories, second_stage

OUT = memories.OUTCOMES


@pytest.fixture(scope="module")
def panel():
    """Six symbols over 120 irregular sessions, with missing rows, missing outcomes and tied states."""
    rng = np.random.default_rng(3)
    days = sorted(dt.date(2020, 1, 1) + dt.timedelta(days=int(k)) for k in rng.choice(250, 120, replace=False))
    rows = []
    for i, day in enumerate(days):
        for s in "abcdef":
            if rng.random() < 0.9:
                known = rng.random() < 0.85
                y = [float(x) if known else None for x in (rng.integers(0, 2), rng.normal(), rng.normal(), rng.normal(), rng.integers(0, 2))]
                rows.append((s, day, i, float(rng.integers(0, 4)), float(rng.integers(0, 4)), *y))
    return pd.DataFrame(rows, columns=["symbol", "ts", "sidx", "za", "zb", *OUT])


@pytest.fixture(scope="module")
def rows(spark, panel):
    schema = "symbol string, ts date, sidx int, za double, zb double, " + ", ".join(f"{o} double" for o in OUT)
    clean = [tuple(None if x != x else x for x in r) for r in panel.itertuples(index=False)]
    return spark.createDataFrame(clean, schema).repartition(3)


def test_own_record_against_pandas(rows, panel):
    got = {(r["symbol"], r["ts"]): r for r in memories.own_record(rows, least=5).collect()}
    assert len(got) == len(panel)
    for o in ("tp", "ret"):
        daily = panel.groupby("ts")[o].mean()
        prior = daily.ewm(halflife=250.0, ignore_na=True).mean().shift(6)
        for symbol, own in panel.groupby("symbol"):
            known = own[o].shift(6)
            n = panel.loc[own.index, "tp"].shift(6).notna().cumsum()
            ewm = known.ewm(halflife="365D", times=pd.to_datetime(own["ts"]), ignore_na=True).mean()
            for k in own.index:
                r = got[symbol, own.at[k, "ts"]]
                eff = min(n[k], 500) / 5
                assert r["own_neff"] == pytest.approx(eff)
                if n[k] < 5:
                    assert r[f"own_{o}"] is None
                else:
                    want = (eff * ewm[k] + 30 * prior[own.at[k, "ts"]]) / (eff + 30)
                    assert r[f"own_{o}"] == pytest.approx(want, abs=1e-9)
                    assert r[f"own_{o}_vs_market"] == pytest.approx(want - prior[own.at[k, "ts"]], abs=1e-9)


def test_memory_against_all_pairs(rows, panel):
    settings = {"k_cross": 7, "k_self": 4, "least_self": 10, "least_pool": 60}
    got = {(r["symbol"], r["ts"]): r for r in memories.memory(rows, ["za", "zb"], block=20, **settings).collect()}
    done = panel[panel[list(OUT)].notna().all(axis=1)]
    month = [(x.year, x.month) for x in panel["ts"]]
    asked = 0
    for m, q in panel.groupby(pd.Series(month, index=panel.index)):
        pool = done[done["sidx"] <= q["sidx"].min() - 6]
        if len(pool) < 60:
            continue
        for r in q.itertuples():
            asked += 1
            near = pool.assign(d=np.round(np.hypot(pool["za"] - r.za, pool["zb"] - r.zb), 9)).sort_values(["d", "sidx", "symbol"])
            own = near[near["symbol"] == r.symbol]
            mean = lambda x, k: {o: np.average(x[o].head(k), weights=1 / (x["d"].head(k) + 0.1)) for o in OUT}
            cross, n, out = mean(near, 7), len(own) / 5, got[r.symbol, r.ts]
            for o in OUT:
                assert out[f"mem_cross_{o}"] == pytest.approx(cross[o], abs=1e-9)
                want = cross[o]
                if len(own) >= 10:
                    self_ = mean(own, 4)
                    assert out[f"mem_self_{o}"] == pytest.approx(self_[o], abs=1e-9)
                    want = (n * self_[o] + 10 * cross[o]) / (n + 10)
                else:
                    assert out[f"mem_self_{o}"] is None
                assert out[f"mem_{o}"] == pytest.approx(want, abs=1e-9)
    assert asked == len(got) > 100


def test_pools_beyond_the_cap_are_sampled_alike(rows):
    run = lambda: sorted(map(tuple, memories.memory(rows, ["za", "zb"], least_pool=60, pool_cap=50).collect()))
    one = run()
    assert one and one == run()
    full = sorted(map(tuple, memories.memory(rows, ["za", "zb"], least_pool=60).collect()))
    assert [r[:2] for r in one] == [r[:2] for r in full] and one != full


def test_nothing_to_remember(rows):
    assert memories.memory(rows.limit(0), ["za", "zb"]).count() == 0
    assert memories.own_record(rows.limit(0)).count() == 0
    short = memories.remembered(rows.where("sidx < 3").withColumn("gone", F.lit(0)), ["za", "zb"], "gone")
    assert short.where("mem_tp is not null or own_tp is not null").count() == 0


def test_arms_of_decided_picks(spark):
    day = dt.date(2020, 1, 6)
    picks = [(day, s, k, p, 0.5, (p or 0) - 0.1, (p or 0) + 0.1, y, net, 1) for s, k, p, y, net in [("a", 1, 0.6, 1.0, 0.03), ("b", 2, 0.4, 0.0, -0.03), ("c", 3, 0.5, 1.0, 0.06), ("d", 4, 0.9, 1.0, 0.09), ("e", 5, None, 0.0, -0.09)]]
    df = spark.createDataFrame(picks, "ts date, symbol string, rk int, meta_p double, tau double, spread_lo double, spread_hi double, label double, net double, block int")
    d = second_stage.decided_picks(df)
    arms = second_stage.nested_books(d).first()
    assert arms["base"] == pytest.approx(0.02) and arms["filtered"] == pytest.approx(0.03) and arms["reranked"] == pytest.approx(0.06)
    assert arms["filtered_minus_base"] == pytest.approx(0.01)
    one = second_stage.nested_summary(d).first()
    assert (one["days_tested"], one["picks_tested"], one["days_all_cash"]) == (1, 3, 0)
    assert one["skipped_share"] == pytest.approx(1 / 3) and one["auc"] == pytest.approx(1.0) and one["band_coverage"] == 1
    block = second_stage.nested_by_block(d).first()
    assert block["base_bp"] == pytest.approx(200) and block["skipped"] == pytest.approx(1 / 3)
