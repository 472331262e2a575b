"""Hard negatives and vector codes against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from panelworks.llm import hard_negatives, vector_codes
from panelworks.llm.hard_negatives import Mining, mine
from panelworks.llm.vector_codes import Codes, compress

ROWS = "vec_id long, label int, v array<double>, q long, part int, extra string"


def integers(rng, n, width, spread=40):
    return [[float(rng.randint(-spread, spread)) for _ in range(width)] for _ in range(n)]


def odd_rows(seed=1, n=160, width=16):
    """Ties, repeated rows, nulls, another length, an id of two vectors."""
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, None]), v) for i, v in enumerate(integers(rng, n, width))]
    rows += [rows[3]] * 9 + [(5, 1, rows[6][2]), (500, 1, rows[7][2]), (501, 2, rows[7][2]), (None, 1, rows[8][2]), (502, 0, None), (503, 1, []), (504, 1, [1.0] * (width // 2)), (505, 0, [0.0] * width)]
    return [r + (9, 8, "x") for r in rows]


def mined(rows, anchors, cfg):
    """(anchor_id, positive_rank, positive_id, positive_score, rank, negative_id, negative_score) by sorting everything."""
    use = [r for r in rows if None not in r[:3] and r[2]]
    out = []
    for a, label, v, *_ in {(i, lab, tuple(v)) for i, lab, v, *_ in anchors if None not in (i, lab, v) and v}:
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(v, w, strict=True)), i, other != label) for i, other, w, *_ in use if i != a and len(w) == len(v))
        same = [(i, -s) for s, i, differs in scored if not differs][: cfg.positives]
        for p, (i, score) in enumerate(same, 1):
            near = [(j, -s) for s, j, differs in scored if differs and cfg.low * score <= -100 * s <= cfg.high * score][: cfg.k]
            out += [(a, p, i, score, k, j, s) for k, (j, s) in enumerate(near, 1)]
    return sorted(out)


NAMES = ("anchor_id", "positive_rank", "positive_id", "positive_score", "rank", "negative_id", "negative_score")


@pytest.mark.parametrize("cfg", [Mining(), Mining(shard_rows=20, block_anchors=7, at_once=3), Mining(k=4, positives=2, low=20, high=110, shard_rows=50)])
def test_mined_like_a_plain_sort(spark, cfg):
    rows = odd_rows()
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = mine(df, df.where("vec_id % 3 = 0 or vec_id > 499"), cfg)
    want = mined(rows, [r for r in rows if r[0] is not None and (r[0] % 3 == 0 or r[0] > 499)], cfg)
    assert want and sorted(tuple(r[c] for c in NAMES) for r in got.collect()) == want


def test_limits_hold_for_any_sign():
    for score in (-7, -1, 0, 1, 2, 99, 10**17):
        low, high = hard_negatives.limits(score, Mining())
        near = range(-10, 200) if abs(score) < 1_000 else (low - 1, low, high, high + 1)
        assert [x for x in near if 50 * score <= 100 * x <= 95 * score] == [x for x in near if low <= x <= high]


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], ROWS)
    some = spark.createDataFrame(odd_rows(n=9), ROWS)
    assert mine(empty, empty).count() == mine(some, empty).count() == mine(empty, some).count() == 0


def test_huge_components_stay_exact(spark):
    rows = [(i, i % 2, [float(2**40 + i), float(2**12)]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<double>")
    cfg = Mining(low=1, high=100)
    clip = lambda x: max(-(2**63) + 1, min(2**63 - 1, x))
    assert all(r.positive_score == clip(r.positive_score) == 2**63 - 1 for r in mine(df, df, cfg).collect())


def coded(rows, cfg):
    """Lloyd rounds with every distance, in Python's integers."""
    use = sorted((r for r in rows if r[2] and len(r[2]) % cfg.parts == 0), key=lambda r: (r[0] is None, r[0], r[2]))
    width = len(use[0][2])
    use = [r for r in use if len(r[2]) == width]
    d = width // cfg.parts
    cut = [[tuple(map(int, r[2][p * d : p * d + d])) for p in range(cfg.parts)] for r in use]
    books = [[c[p] for c in cut[: cfg.entries]] for p in range(cfg.parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(cfg.parts)] for c in cut]
    for _ in range(cfg.rounds):
        codes = nearest()
        for p in range(cfg.parts):
            for e in range(len(books[p])):
                own = [c[p] for c, code in zip(cut, codes, strict=True) if code[p] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    codes = nearest()
    errors = [sum(far(c[p], books[p][code[p]]) for p in range(cfg.parts)) for c, code in zip(cut, codes, strict=True)]
    by_label = {}
    for r, e in zip(use, errors, strict=True):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    out = [(r[0], r[1], "".join(f"{k:02x}" for k in code), e, by_label[r[1]]) for r, code, e in zip(use, codes, errors, strict=True)]
    return sorted(map(repr, out)), books


@pytest.mark.parametrize("cfg", [Codes(parts=4, entries=8), Codes(parts=4, entries=44, rounds=4, chunk=7), Codes(parts=8, entries=5, rounds=0), Codes(parts=4, entries=16, rounds=3, broadcast_labels=0)])
def test_codes_like_plain_rounds(spark, cfg):
    rows = odd_rows(2)
    got, books = compress(spark.createDataFrame(rows, ROWS).repartition(4), cfg)
    want, plain = coded(rows, cfg)
    assert sorted(repr((r.vec_id, r.label, r.code, r.error, r.label_error)) for r in got.collect()) == want
    assert books.tolist() == [[list(e) for e in b] for b in plain]
    assert vector_codes.digest(books) == hashlib.sha256(",".join(str(x) for b in plain for e in b for x in e).encode()).hexdigest()


def test_no_rows_no_codes(spark):
    got, books = compress(spark.createDataFrame([], ROWS))
    assert got.count() == 0 and books.size == 0
    odd = spark.createDataFrame([(1, 1, [1.0, 2.0, 3.0], 1, 1, "")], ROWS)
    assert compress(odd)[0].count() == 0


def test_components_are_held(spark):
    rows = [(i, 1, [1e30, -1e30, 0.0, float(i)]) for i in range(3)]
    got, books = compress(spark.createDataFrame(rows, "vec_id long, label int, v array<double>"), Codes(parts=2, entries=2))
    assert books.min() == -(2**27) and books.max() == 2**27 and got.count() == 3


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.integers(-400, 400, (30, 2, 4))
    x = centres[rng.integers(0, 30, 3_000)] + rng.integers(-9, 9, (3_000, 2, 4))
    books = x[:32].swapaxes(0, 1).copy()
    kept, computed = vector_codes.first_bounds(x, books), []
    for _ in range(4):
        new = books.copy()
        for p in range(2):
            for e in range(32):
                own = x[kept.code[:, p] == e, p]
                new[p, e] = own.sum(0) // len(own) if len(own) else new[p, e]
        kept, books = vector_codes.next_bounds(x, kept, new, vector_codes.moved(books, new), computed), new
        for p in range(2):
            d2 = ((x[:, p, None] - books[p]) ** 2).sum(-1)
            true = np.sqrt(d2.astype(float))
            assert (kept.code[:, p] == d2.argmin(1)).all()
            assert (kept.lower[:, p] <= true).all() and (kept.upper[:, p] >= true.min(1)).all()
    assert sum(computed) < 0.2 * 4 * x.shape[0] * 2 * 32


def test_decoded_vector_is_the_entries_in_turn():
    books = np.arange(12).reshape(2, 3, 2)
    assert vector_codes.decoded("0201", books).tolist() == [4, 5, 8, 9]
