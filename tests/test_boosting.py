"""Boosted trees against a plain version; isotonic fits and bootstrap intervals against theirs."""

import datetime as dt
import hashlib

import numpy as np
import pytest

from panelworks.operators import boosting, evidence, isotonic, models
from panelworks.operators.boosting import Boosting
from panelworks.sources.tables import sessions

rng = np.random.default_rng(9)
N = 700
X = np.column_stack([np.round(rng.normal(size=N), 1), rng.integers(0, 4, N), np.round(rng.normal(size=N), 1)])
X[rng.random((N, 3)) < 0.15] = np.nan
D = np.nan_to_num(X[:, 0]) + rng.normal(size=N)
Y = (np.nan_to_num(X[:, 0], nan=0.8) + 0.3 * np.nan_to_num(X[:, 1]) + rng.normal(size=N) > 0.5).astype(float)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, float(Y[k]), float(D[k]), *(None if np.isnan(v) else float(v) for v in X[k])) for k in range(N)]
    rows += [(N + k, None, None, 1.0, 1.0, 1.0) for k in range(3)]
    return spark.createDataFrame(rows, "k long, label double, d double, a double, b double, c double").repartition(5)


def grown(x, y, cfg):
    """Scores of boosted trees grown by looking at every split of every node."""
    base = np.log(y.mean() / (1 - y.mean())) if cfg.loss == "log" else np.median(y)
    f, gains = np.full(len(y), base), np.zeros(x.shape[1])
    for _ in range(cfg.rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = (p - y, p * (1 - p)) if cfg.loss == "log" else (np.sign(f - y), np.ones(len(y)))

        def node(rows, level, f=f, g=g, h=h):
            value = cfg.rate * (-g[rows].sum() / (h[rows].sum() + cfg.l2) if cfg.loss == "log" else np.median((y - f)[rows]))
            gain = lambda at: g[at].sum() ** 2 / (h[at].sum() + cfg.l2)
            best = (1e-9, None, None, None)
            for k in range(x.shape[1]) if level < cfg.depth else ():
                for edge in [*np.unique(x[~np.isnan(x[:, k]), k]), np.inf]:
                    for missing in (True, False):
                        left = np.where(np.isnan(x[rows, k]), missing, x[rows, k] <= edge)
                        if cfg.leaf <= left.sum() <= len(rows) - cfg.leaf:
                            got = gain(rows[left]) + gain(rows[~left]) - gain(rows)
                            if got > best[0] + 1e-7:
                                best = (got, k, rows[left], rows[~left])
            if best[1] is None:
                return [(rows, value)]
            gains[best[1]] += best[0]
            return node(best[2], level + 1) + node(best[3], level + 1)

        step = np.zeros(len(y))
        for rows, value in node(np.arange(len(y)), 0):
            step[rows] = value
        f = f + step
    return (1 / (1 + np.exp(-f)) if cfg.loss == "log" else f), gains


@pytest.mark.parametrize(("loss", "target"), [("log", "label"), ("absolute", "d")])
def test_trees_like_plain_ones(spark, table, loss, target):
    cfg = Boosting(rounds=4, depth=3, rate=0.3, leaf=20, l2=1.0, loss=loss, block=100, stored=2)
    features = ["a", "b", "c"]
    train = table.where("label is not null")
    model = boosting.fit(train, features, target, cfg)
    got = dict(map(tuple, train.select("k", model.score(spark)).collect()))
    want, gains = grown(X, Y if loss == "log" else D, cfg)
    assert len(model.trees) == 4 and model.gains() == pytest.approx(gains, rel=1e-5)
    assert [got[k] for k in range(N)] == pytest.approx(want.tolist(), abs=1e-6)


def test_missing_values_choose_their_side(spark):
    rows = [(float(k % 2), None if k % 2 else float(k % 7)) for k in range(200)]
    df = spark.createDataFrame(rows, "label double, x double")
    model = boosting.fit(df, ["x"], "label", Boosting(rounds=20, depth=2, rate=0.5, leaf=5))
    got = df.select("label", model.score(spark).alias("p")).distinct().collect()
    assert all(abs(r.p - r.label) < 0.1 for r in got)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "label double, x double")
    one = spark.createDataFrame([(1.0, 2.0)] * 30, "label double, x double")
    cfg = Boosting(rounds=3, leaf=2)
    assert boosting.fit(empty, ["x"], "label", cfg).trees == []
    assert one.select(boosting.fit(one, ["x"], "label", cfg).score(spark).alias("p")).first().p > 0.99
    assert boosting.fit(one, ["x"], "label", Boosting(rounds=3, leaf=2, loss="absolute")).base == 1.0


def test_model_comes_back(spark, table, tmp_path):
    model = boosting.fit(table, ["a", "b"], "label", Boosting(rounds=3, depth=2, leaf=20))
    model.save(spark, str(tmp_path / "m"))
    other = boosting.Model.load(spark, str(tmp_path / "m"))
    x = [X[:, 0], X[:, 1]]
    assert (model.raw(model.binned(x)) == other.raw(other.binned(x))).all() and (model.base, model.features) == (other.base, other.features)


def test_out_of_fold_bags_come_from_their_own_days(spark, monkeypatch):
    days = [dt.date(2022, 1, 1) + dt.timedelta(days=2 * k) for k in range(60)]
    rows = [(d, f"s{j}", j + 1, float((k + j) % 2), float(k)) for k, d in enumerate(days) for j in range(4)]
    df = spark.createDataFrame(rows, "ts date, symbol string, rk int, label double, x double")
    asked = []
    real = models.hashed_days
    monkeypatch.setattr(models, "hashed_days", lambda s, share, b: asked.append(s.count()) or real(s, share, b))
    models.fit_meta(df, sessions(df), ["x"], bags=1, oof_bags=1, blocks=3, kind="logistic")
    assert len(asked) == 4 and asked[-1] == 60 and all(n < 45 for n in asked[:3])


def pooled(points):
    """{x: fit} by pooling adjacent violators one after the other."""
    by = {}
    for x, y in points:
        by.setdefault(x, []).append(y)
    stack = []
    for x in sorted(by):
        stack.append([[x], sum(by[x]), len(by[x])])
        while len(stack) > 1 and stack[-2][1] * stack[-1][2] >= stack[-1][1] * stack[-2][2]:
            xs, s, n = stack.pop()
            stack[-1] = [stack[-1][0] + xs, stack[-1][1] + s, stack[-1][2] + n]
    return {x: s / n for xs, s, n in stack for x in xs}


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_isotonic_over_ranges(spark, parts):
    points = [(float(np.round(x, 2)), float(rng.random() < x)) for x in rng.random(600)]
    df = spark.createDataFrame([*points, (None, 1.0), (0.5, None), (float("nan"), 0.0)], "p double, y double").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        model = isotonic.isotonic(df, "p", "y", fewer=4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = pooled(points)
    xs = sorted(want)
    ask = spark.createDataFrame([(x,) for x in [*xs, -1.0, 2.0, 0.12345, None]], "p double")
    got = {r.p: r.p_cal for r in isotonic.calibrated(model, ask, "p").collect()}
    assert all(got[x] == pytest.approx(want[x], abs=1e-12) for x in xs)
    assert (got[-1.0], got[2.0]) == (want[xs[0]], want[xs[-1]]) and got[None] is None
    assert got[0.12345] == pytest.approx(np.interp(0.12345, xs, [want[x] for x in xs]), abs=1e-12)


def test_isotonic_without_rows(spark):
    empty = spark.createDataFrame([], "p double, y double")
    model = isotonic.isotonic(empty, "p", "y")
    assert isotonic.calibrated(model, spark.createDataFrame([(0.3,)], "p double"), "p").first().p_cal is None


@pytest.mark.parametrize("n", [9, 10, 13, 61])
def test_intervals_of_counted_draws(spark, n):
    x = rng.normal(size=n)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=k), float(v), None) for k, v in enumerate(x)]
    got = evidence.block_bootstrap(spark.createDataFrame(rows, "ts date, a double, none double"), ["a", "none"], draws=150).collect()
    assert len(got) == 1 and got[0].n_dates == n and got[0].mean == pytest.approx(x.mean())
    means = []
    for d in range(150):
        taken = []
        for b in range(-(-n // 5)):
            start = int(hashlib.md5(f"a:7:{d}:{b}".encode()).hexdigest()[:8], 16) % n
            taken += [x[(start + j) % n] for j in range(5)]
        means.append(np.mean(taken[:n]))
    if n < 10:
        assert got[0].lo is None and got[0].hi is None
    else:
        assert (got[0].lo, got[0].hi) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
