"""The shared views again, as SQL for DuckDB."""

from __future__ import annotations

_ORDER = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_suppkey"


def _labels() -> str:
    up = lambda k, e: f"h{k} / {e} - 1 >= tp"
    down = lambda k, e: f"l{k} / {e} - 1 <= -sl"
    gap = lambda k: f"(o{k} / o1 - 1)"
    plain = lambda e: "CASE " + " ".join(f"WHEN {down(k, e)} THEN -1.0::DOUBLE WHEN {up(k, e)} THEN 1.0::DOUBLE" for k in range(1, 6)) + " ELSE 0.0::DOUBLE END"
    steps = [(down(1, "o1"), "-1.0", "-sl"), (up(1, "o1"), "1.0", "tp")]
    for k in range(2, 6):
        steps += [(f"{gap(k)} <= -sl", "-1.0", gap(k)), (f"{gap(k)} >= tp", "1.0", gap(k)), (down(k, "o1"), "-1.0", "-sl"), (up(k, "o1"), "1.0", "tp")]
    ft_c = "CASE " + " ".join(f"WHEN {t} THEN {e}::DOUBLE" for t, e, _ in steps) + " ELSE 0.0::DOUBLE END"
    xr_c = "CASE " + " ".join(f"WHEN {t} THEN {r}" for t, _, r in steps) + " ELSE c5 / o1 - 1 END"
    first = lambda test: "CASE " + " ".join(f"WHEN {test(k)} THEN {k}::BIGINT" for k in range(1, 6)) + " END"
    stretched = "CASE " + " ".join(f"WHEN {down(k, 'close')} THEN -sl WHEN h{k} / close - 1 >= 2.0 * atr / close THEN 2.0 * atr / close" for k in range(1, 6)) + " ELSE c5 / close - 1 END"
    leads = ", ".join(f"lead({c}, {k}) OVER w AS {c[0]}{k}" for k in range(1, 6) for c in ("open", "high", "low"))
    return f"""
tr AS (SELECT *, lag(close) OVER w AS pc, count(*) OVER (PARTITION BY symbol) AS n_bars FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
tr2 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM tr),
atr AS (SELECT *, CASE WHEN count(tr) OVER r = 14 THEN (sum(tr::DECIMAL(28, 12)) OVER r)::DOUBLE / 14 END AS atr FROM tr2 WINDOW r AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
fwd AS (SELECT *, {leads}, lead(close, 5) OVER w AS c5, 1.5 * atr / close AS tp, 1.0 * atr / close AS sl, n_bars > 19 AS enough FROM atr WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
tch AS (SELECT *, enough AND c5 IS NOT NULL AND atr IS NOT NULL AND close > 0 AS ok, {plain('close')} AS ta, {plain('o1')} AS tb, {ft_c} AS tc, {xr_c} AS rc,
  {first(lambda k: up(k, 'close'))} AS dt, {first(lambda k: down(k, 'close'))} AS ds, {stretched} AS rs FROM fwd),
labels_all AS (SELECT symbol, ts, open, high, low, close, atr,
  CASE WHEN ok THEN ta END AS ft_a, CASE WHEN ok THEN CASE ta WHEN 1 THEN tp WHEN -1 THEN -sl ELSE c5 / close - 1 END END AS xr_a,
  CASE WHEN ok AND o1 > 0 THEN tb END AS ft_b, CASE WHEN ok AND o1 > 0 THEN CASE tb WHEN 1 THEN tp WHEN -1 THEN -sl ELSE c5 / o1 - 1 END END AS xr_b,
  CASE WHEN ok AND o1 > 0 THEN tc END AS ft_c, CASE WHEN ok AND o1 > 0 THEN rc END AS xr_c,
  CASE WHEN ok AND o1 > 0 THEN o1 / close - 1 END AS gap1,
  CASE WHEN ok THEN dt END AS days_tp, CASE WHEN ok THEN ds END AS days_sl, CASE WHEN ok THEN rs END AS xr_s,
  CASE WHEN ok THEN greatest(h1, h2, h3, h4, h5) / close - 1 END AS mfe, CASE WHEN ok THEN least(l1, l2, l3, l4, l5) / close - 1 END AS mae FROM tch)"""


VIEWS = {
    "bars": f"""
bars AS (SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, first(px {_ORDER}) AS open, max(px) AS high, min(px) AS low, last(px {_ORDER}) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL)""",
    "labels": _labels(),
    "scores": """
mom AS (SELECT *, close / lag(close, 5) OVER w - 1 AS m5, close / lag(close, 1) OVER w - 1 AS m1 FROM labels_all WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
scores AS (SELECT ts, symbol, 0.5 + 0.5 * m5 / (1 + abs(m5)) AS p_raw, 0.5 + 0.5 * m1 / (1 + abs(m1)) AS p_short, xr_a AS exit_ret, ft_a AS ft, CAST(xr_a - 0.0035 > 0 AS INT)::DOUBLE AS y, CAST(ft_a = 1 AS INT)::DOUBLE AS hit,
  xr_a - 0.0035 AS net, gap1, xr_a, xr_b, xr_c, ft_c, xr_s, days_tp, days_sl, mfe, mae, close, atr FROM mom WHERE m5 IS NOT NULL AND xr_a IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY p_raw DESC, symbol) AS rk FROM scores),
axis AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS sidx, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM scores))""",
    "panel": """
panel AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS ts, user_id AS symbol, round(avg(value), 9) AS value FROM events GROUP BY ALL)""",
    "docs": """
docs AS (SELECT doc_id, n_chars::DOUBLE / (n_chars::DOUBLE + 1500.0) AS p, quality::BIGINT AS y FROM documents JOIN labels USING (doc_id))""",
}
NEEDS = {"bars": ["bars"], "labels": ["bars", "labels"], "scores": ["bars", "labels", "scores"], "panel": ["panel"], "docs": ["docs"]}


def sql(view: str, body: str, more: str = "") -> str:
    parts = [VIEWS[v] for v in NEEDS[view]] + ([more] if more else [])
    return "WITH " + ",".join(parts) + "\n" + body


def interval_sql(series: str, block: int = 5, draws: int = 2000, seed: int = 7) -> str:
    """CTEs that end in ``intervals`` (series, mean, lo, hi, n_dates) of ``series``, a query of (series, ts, value)."""
    lead = lambda k: f"lead(value, {k}) OVER (PARTITION BY series ORDER BY i)" if k else "value"
    whole = " + ".join(lead(k) for k in range(block))
    cut = " + ".join(f"CASE WHEN (n - 1) % {block} >= {k} THEN {lead(k)} ELSE 0 END" for k in range(block))
    return f"""
sr AS MATERIALIZED (SELECT series, ts, value FROM ({series}) WHERE value IS NOT NULL),
si AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM sr),
sb AS MATERIALIZED (SELECT * FROM (SELECT series, i, n, {whole} AS whole, {cut} AS cut FROM (FROM si UNION ALL SELECT series, value, i + n, n FROM si WHERE i < {block})) WHERE i < n),
sm AS (SELECT series, avg(value) AS mean, count(*) AS n_dates FROM sr GROUP BY series),
sd AS (SELECT series, n_dates, draw, unnest(range(CAST(ceil(n_dates / {block}.0) AS BIGINT))) AS b FROM sm, range({draws}) x(draw) WHERE n_dates >= {2 * block}),
st AS (SELECT *, ('0x' || substr(md5(concat_ws(':', series, {seed}, draw, b)), 1, 8))::BIGINT % n_dates AS i FROM sd),
sw AS (SELECT series, draw, sum(CASE WHEN b = ceil(n_dates / {block}.0) - 1 THEN cut ELSE whole END) / n_dates AS drawn FROM st JOIN sb USING (series, i) GROUP BY series, draw, n_dates),
intervals AS (SELECT series, mean, quantile_cont(drawn, 0.025) AS lo, quantile_cont(drawn, 0.975) AS hi, n_dates FROM sm LEFT JOIN sw USING (series) GROUP BY series, mean, n_dates)"""


def isotonic_sql(points: str) -> str:
    """CTEs that end in ``fitted`` (x, v): the isotonic fit at each x of ``points``, a query of (x, y), by its min-max form."""
    return f"""
ip AS (SELECT x, sum(y)::DOUBLE AS s, count(*) AS n FROM ({points}) GROUP BY x),
iq AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS ts, sum(n) OVER (ORDER BY x) AS tn FROM ip),
im AS (SELECT a.i, b.i AS j, (b.ts - a.ts + a.s) / (b.tn - a.tn + a.n)::DOUBLE AS m FROM iq a JOIN iq b ON b.i >= a.i),
il AS (SELECT i, j, min(m) OVER (PARTITION BY i ORDER BY j DESC) AS m FROM im),
fitted AS (SELECT x, v FROM (SELECT j, max(m) AS v FROM il GROUP BY j) JOIN iq ON iq.i = j)"""


def interpolated(x: str, at: str) -> str:
    """Query of ``at`` (a table with a column ``x``) and v: between the fitted points straight lines, beyond them their ends."""
    return f"""SELECT d.*, CASE WHEN lo.x IS NULL THEN hi.v WHEN hi.x IS NULL OR hi.x = lo.x THEN lo.v ELSE lo.v + (hi.v - lo.v) * (d.{x} - lo.x) / (hi.x - lo.x) END AS v
FROM {at} d ASOF LEFT JOIN fitted lo ON d.{x} >= lo.x ASOF LEFT JOIN fitted hi ON d.{x} <= hi.x"""
