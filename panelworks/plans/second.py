"""Queries on records, memories, the second stage and runs held against each other, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks.functions import net_return
from panelworks.operators import analogues, evidence, memories, panel_features, ranking, second_stage, splits
from panelworks.plans.catalogue import _RET, DIMS, SPACE_SQL, _avg_rank, _distance, _folds, _form, _learning, _states, query, r, tidy
from panelworks.plans.oracle import sql
from panelworks.plans.trades import _MARKET, _TWO, _two
from panelworks.plans.views import labelled, scores, stored_bars
from panelworks.sources.tables import sessions

_OUT = memories.OUTCOMES


def _each(pattern: str) -> str:
    return ", ".join(pattern.replace("@", o) for o in _OUT)


def _outcomes(df, ft: str, ret: str):
    return df.withColumns({"tp": (F.col(ft) == 1).cast("double"), "ret": F.col(ret), "sl": (F.col(ft) == -1).cast("double")})


_BACK = "(PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
_OWN = f"""
oc AS (SELECT symbol, ts, (ft_a = 1)::INT::DOUBLE AS tp, xr_a AS ret, mfe, mae, (ft_a = -1)::INT::DOUBLE AS sl FROM labels_all),
k0 AS (SELECT *, {_each('lag(@, 6) OVER w AS k_@')}, coalesce(date_diff('day', lag(ts) OVER w, ts), 0) AS days FROM oc WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
k1 AS (SELECT *, {_each('sum(CASE WHEN k_@ IS NOT NULL THEN days ELSE 0 END) OVER u AS a_@')} FROM k0 WINDOW u AS {_BACK}),
k2 AS (SELECT symbol, ts, {_each('sum(pow(2.0, a_@ / 365.0) * k_@) OVER u / sum(CASE WHEN k_@ IS NOT NULL THEN pow(2.0, a_@ / 365.0) END) OVER u AS e_@')}, count(k_tp) OVER u AS n FROM k1 WINDOW u AS {_BACK}),
p0 AS (SELECT ts, {_each('avg(@) AS @')} FROM oc GROUP BY ts),
p1 AS (SELECT *, {_each('CASE WHEN @ IS NOT NULL THEN pow(2.0, count(@) OVER u / 250.0) END AS w_@')} FROM p0 WINDOW u AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)),
p2 AS (SELECT ts, {_each('sum(w_@ * @) OVER u / sum(w_@) OVER u AS m_@')} FROM p1 WINDOW u AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)),
p3 AS (SELECT ts, {_each('lag(m_@, 6) OVER (ORDER BY ts) AS p_@')} FROM p2),
o0 AS (SELECT symbol, ts, least(n, 500) / 5.0 AS own_neff, p_tp, p_ret, {_each('CASE WHEN n >= 20 THEN (least(n, 500) / 5.0 * e_@ + 30 * p_@) / (least(n, 500) / 5.0 + 30) END AS own_@')} FROM k2 LEFT JOIN p3 USING (ts)),
own AS (SELECT symbol, ts, {_each('own_@')}, own_tp - p_tp AS own_tp_vs_market, own_ret - p_ret AS own_ret_vs_market, own_neff FROM o0)"""
_OWN_NAMES = [*(f"own_{o}" for o in _OUT), "own_tp_vs_market", "own_ret_vs_market", "own_neff"]


@query(sql("labels", f"SELECT symbol, ts, {r(*_OWN_NAMES)} FROM own", _OWN))
def own_record(spark, d):
    return tidy(memories.own_record(_outcomes(labelled(spark, d), "ft_a", "xr_a")), "symbol", "ts", *_OWN_NAMES)


_DIST = _distance(len(DIMS))
_MEMORY = f"""{SPACE_SQL},
mm AS MATERIALIZED (SELECT * EXCLUDE (exit_ret), date_trunc('month', ts) AS month, (ft = 1)::INT::DOUBLE AS tp, exit_ret AS ret, (ft = -1)::INT::DOUBLE AS sl FROM zz),
fin AS MATERIALIZED (SELECT * FROM mm WHERE {_each('@ IS NOT NULL').replace(', ', ' AND ')}),
cu AS (SELECT sidx, sum(k) OVER (ORDER BY sidx) AS pool FROM (SELECT sidx, count(fin.sidx) AS k FROM (SELECT DISTINCT sidx FROM mm) LEFT JOIN fin USING (sidx) GROUP BY sidx)),
mo AS MATERIALIZED (SELECT month, cut FROM (SELECT month, min(sidx) - 6 AS cut FROM mm GROUP BY month) JOIN cu ON cu.sidx = cut WHERE pool >= 5000),
cr AS (SELECT symbol, ts, {_each('sum(@ / (d + 0.1)) / sum(1 / (d + 0.1)) AS mem_cross_@')}, avg(d) AS mem_cross_dist FROM (SELECT q.symbol, q.ts, {_each('p.@')}, {_DIST} AS d FROM mm q JOIN mo USING (month) JOIN fin p ON p.sidx <= mo.cut QUALIFY row_number() OVER (PARTITION BY q.symbol, q.ts ORDER BY d, p.sidx, p.symbol) <= 50) GROUP BY symbol, ts),
se AS (SELECT symbol, ts, {_each('sum(@ / (d + 0.1)) / sum(1 / (d + 0.1)) AS mem_self_@')}, max(n)::DOUBLE AS mem_self_n, avg(d) AS mem_self_dist FROM (SELECT q.symbol, q.ts, {_each('p.@')}, {_DIST} AS d, count(*) OVER (PARTITION BY q.symbol, q.ts) AS n FROM mm q JOIN mo USING (month) JOIN fin p ON p.symbol = q.symbol AND p.sidx <= mo.cut QUALIFY row_number() OVER (PARTITION BY q.symbol, q.ts ORDER BY d, p.sidx) <= 20) WHERE n >= 30 GROUP BY symbol, ts),
m2 AS (SELECT *, coalesce(mem_self_n, 0) / 5 AS k FROM cr LEFT JOIN se USING (symbol, ts)),
m3 AS (SELECT *, {_each('CASE WHEN mem_self_@ IS NOT NULL THEN (k * mem_self_@ + 10 * mem_cross_@) / (k + 10) ELSE mem_cross_@ END AS mem_@')} FROM m2),
mem AS (SELECT *, mem_self_tp - mem_cross_tp AS mem_gap_tp, mem_self_ret - mem_cross_ret AS mem_gap_ret, sqrt(greatest(0.0, mem_tp * (1 - mem_tp)) / greatest(k + 50 / 5, 1)) AS mem_tp_se FROM m3)"""
_MEM_NAMES = [*(f"mem_{w}{o}" for w in ("cross_", "self_", "") for o in _OUT), "mem_self_n", "mem_self_dist", "mem_cross_dist", "mem_gap_tp", "mem_gap_ret", "mem_tp_se"]


@query(sql("scores", f"SELECT symbol, ts, {r(*_MEM_NAMES)} FROM mem", _MEMORY))
def memory(spark, d):
    x = _outcomes(_states(spark, d), "ft", "exit_ret")
    return tidy(memories.memory(x, DIMS), "symbol", "ts", *_MEM_NAMES)


_SOME = "oc AS (SELECT symbol, ts, (ft = 1)::INT::DOUBLE AS tp, exit_ret AS ret, mfe, mae, (ft = -1)::INT::DOUBLE AS sl FROM scores)" + _OWN[_OWN.index(",\nk0") :]


@query(sql("scores", f"SELECT symbol, ts, missing AS state_missing, {r(*_OWN_NAMES, *_MEM_NAMES)} FROM zz LEFT JOIN own USING (symbol, ts) LEFT JOIN mem USING (symbol, ts) WHERE coalesce({', '.join(_OWN_NAMES + _MEM_NAMES)}) IS NOT NULL", _SOME + "," + _MEMORY))
def remembered(spark, d):
    """Records and memories of every scored row, in one frame."""
    x = _outcomes(_states(spark, d), "ft", "exit_ret")
    return tidy(memories.remembered(x, DIMS, "missing"), "symbol", "ts", "state_missing", *_OWN_NAMES, *_MEM_NAMES)


_CASES = f"""{SPACE_SQL},
qq AS (SELECT z.* FROM zz z JOIN ranked USING (ts, symbol) WHERE ts = (SELECT max(ts) FROM scores) AND rk <= 10),
cn AS MATERIALIZED (SELECT q.symbol, q.ts, p.symbol AS who, p.sidx, p.ft, p.exit_ret, p.mfe, p.mae, p.days_tp, {_distance(len(DIMS))} AS d FROM qq q JOIN zz p ON p.sidx <= q.sidx - 6),
near AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d, sidx) AS i FROM cn WHERE who = symbol),
taken AS (SELECT symbol, 0::BIGINT AS i, []::BIGINT[] AS picks FROM qq
  UNION ALL SELECT t.symbol, n.i, CASE WHEN len(picks) < 10 AND len(list_filter(picks, lambda x: abs(x - n.sidx) < 5)) = 0 THEN list_append(picks, n.sidx) ELSE picks END FROM taken t JOIN near n ON n.symbol = t.symbol AND n.i = t.i + 1),
own AS (SELECT symbol, unnest(picks) AS sidx, unnest(range(1, len(picks) + 1)) AS place FROM (SELECT symbol, arg_max(picks, i) AS picks FROM taken GROUP BY symbol)),
ca AS (SELECT n.* EXCLUDE (i), 'self' AS scope, place FROM near n JOIN own USING (symbol, sidx) UNION ALL SELECT *, 'cross', row_number() OVER (PARTITION BY symbol ORDER BY d, sidx, who) AS place FROM cn QUALIFY place <= 10),
mk AS (SELECT sidx, avg(exit_ret) AS market_ret FROM zz GROUP BY sidx)"""
_CASE_NAMES = ("d", "exit_ret", "mfe", "mae", "days_tp", "market_ret")


@query(sql("scores", f"SELECT symbol, ts, scope, place, who, sidx, ft::BIGINT AS ft, {r(*[c.replace('days_tp', 'days_tp::DOUBLE=>days_tp') for c in _CASE_NAMES])} FROM ca JOIN mk USING (sidx)", _CASES).replace("WITH ", "WITH RECURSIVE ", 1))
def analogue_cases(spark, d):
    """The latest session's ten best: their own nearest past cases, apart from each other, the nearest of all symbols, and what became of them."""
    x = _states(spark, d)
    asked = ranking.ranked(x).where("rk <= 10").join(F.broadcast(x.agg(F.max("ts").alias("ts"))), "ts", "left_semi")  # one row
    out = analogues.cases(x, asked, DIMS).withColumn("ft", F.col("ft").cast("long"))
    return tidy(out, "symbol", "ts", "scope", "place", "who", "sidx", "ft", *_CASE_NAMES)


_META = f"""
st AS (SELECT ts, symbol, rk, (p_raw - avg(p_raw) OVER d) / nullif(stddev_samp(p_raw) OVER d, 0) AS score_z, p_raw - lead(p_raw) OVER (PARTITION BY ts ORDER BY rk) AS gap_next, max(CASE WHEN rk = 3 THEN p_raw END) OVER d AS third, max(CASE WHEN rk = 4 THEN p_raw END) OVER d AS fourth, p_raw, (net > 0)::BIGINT AS win FROM ranked WINDOW d AS (PARTITION BY ts)),
cw AS (SELECT ts, count(*) FILTER (p_raw >= third * 0.99) AS top_crowding FROM st GROUP BY ts),
ps AS (SELECT ts, symbol, CASE WHEN sidx > 0 THEN coalesce(sum(CASE WHEN rk <= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY sidx RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)::BIGINT END AS top10_presence5 FROM ranked JOIN axis USING (ts)),
fm AS (SELECT ts, {', '.join(_form(w).replace('=>', ' AS ') for w in (5, 20, 60))} FROM (SELECT ts, lag(net, 6) OVER (ORDER BY ts) AS known FROM (SELECT ts, avg(net) AS net FROM ranked WHERE rk <= 3 GROUP BY ts)))"""
_META_NAMES = ["p_raw", "score_z", "gap_next", "day_gap_3_4", "form_5", "form_20", "form_60", "ret1", "ret5", "gapvol20", "mk_ret1", "mk_breadth", "mk_dispersion", "mk_vol20"]


@query(sql("scores", f"SELECT ts, symbol, rk, top_crowding, top10_presence5, win, {r(*[c.replace('day_gap_3_4', 'third - fourth=>day_gap_3_4') for c in _META_NAMES])} FROM st JOIN cw USING (ts) LEFT JOIN ps USING (ts, symbol) LEFT JOIN fm USING (ts) LEFT JOIN rg USING (symbol, ts) LEFT JOIN m1 USING (ts) WHERE rk <= 10", _META + "," + _RET + "," + _MARKET))
def meta_features(spark, d):
    b = stored_bars(spark, d)
    x = second_stage.meta_features(scores(spark, d, b), b)
    return tidy(x, "ts", "symbol", "rk", "top_crowding", "top10_presence5", "win", *_META_NAMES)


_NESTED = f"""
fo AS ({_folds(0.40, 4)}),
pk AS (SELECT r.*, block, rk <= 3 AND p_short >= 0.5 AS keep, row_number() OVER (PARTITION BY ts ORDER BY p_short DESC NULLS LAST, rk) AS mrank FROM ranked r JOIN fo ON ts BETWEEN test_start AND test_end WHERE rk <= 5),
pw AS (SELECT *, CASE WHEN rk <= 3 THEN greatest(0.5, least(1.5, p_short / avg(CASE WHEN rk <= 3 THEN p_short END) OVER (PARTITION BY ts))) END AS w FROM pk),
bk AS (SELECT ts, sum(CASE WHEN rk <= 3 THEN net ELSE 0 END) / 3 AS base, sum(CASE WHEN keep THEN net ELSE 0 END) / 3 AS filtered, sum(CASE WHEN rk <= 3 THEN net * sz ELSE 0 END) / 3 AS sized, sum(CASE WHEN mrank <= 3 THEN net ELSE 0 END) / 3 AS reranked FROM (SELECT *, w * 3 / sum(w) OVER (PARTITION BY ts) AS sz FROM pw) GROUP BY ts),
t3 AS (SELECT *, p_short AS p FROM pk WHERE rk <= 3)"""
_DELTAS = [f"{c}_minus_base" for c in ("filtered", "sized", "reranked")]


def _decided(spark, d):
    """The short score as second stage on the four later blocks of days, with a cut at one half and a band around the first score."""
    s = scores(spark, d)
    folds = F.broadcast(splits.forward_blocks(sessions(s), 4, 0.40))  # a row per block
    pool = ranking.ranked(s).where("rk <= 5").join(folds, F.col("ts").between(F.col("test_start"), F.col("test_end")))
    pool = pool.withColumns({"meta_p": F.col("p_short"), "tau": F.lit(0.5), "spread_lo": F.col("p_raw") - 0.05, "spread_hi": F.col("p_raw") + 0.05, "label": F.col("y"), "net": net_return()})
    return second_stage.decided_picks(pool.select("ts", "symbol", "rk", "block", "meta_p", "tau", "spread_lo", "spread_hi", "label", "net"))


@query(sql("scores", f"SELECT ts, {r('base', 'filtered', 'sized', 'reranked', *[f'{c[:-11]} - base=>{c}' for c in _DELTAS])} FROM bk", _NESTED))
def nested_books(spark, d):
    return tidy(second_stage.nested_books(_decided(spark, d)))


@query(sql("scores", f"""SELECT (SELECT count(DISTINCT ts) FROM t3) AS days_tested, (SELECT count(*) FROM (SELECT ts FROM t3 GROUP BY ts HAVING count(*) FILTER (keep) = 0)) AS days_all_cash, count(*) AS picks_tested,
{r('1 - count(*) FILTER (keep) / count(*)::DOUBLE=>skipped_share', 'avg(y)=>base_rate', 'avg((p - y) * (p - y))=>brier', '1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y)))=>brier_skill', 'avg((p BETWEEN p_raw - 0.05 AND p_raw + 0.05)::INT)=>band_coverage', '(SELECT (sum(a) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) FROM (SELECT y, ' + _avg_rank('p', '1') + ' AS a FROM t3))=>auc')} FROM t3""", _NESTED))
def nested_summary(spark, d):
    x = second_stage.nested_summary(_decided(spark, d))
    return tidy(x, "days_tested", "days_all_cash", "picks_tested", "skipped_share", "base_rate", "brier", "brier_skill", "band_coverage", "auc")


@query(sql("scores", f"SELECT block, {r('avg(b) * 1e4=>base_bp', 'avg(f) * 1e4=>filtered_bp', 'sum(o) / sum(n)=>skipped')} FROM (SELECT block, ts, sum(net) / 3 AS b, sum(CASE WHEN keep THEN net ELSE 0 END) / 3 AS f, count(*) FILTER (NOT keep) AS o, count(*) AS n FROM t3 GROUP BY block, ts) GROUP BY block", _NESTED))
def nested_by_block(spark, d):
    return tidy(second_stage.nested_by_block(_decided(spark, d)))


@query(sql("scores", f"SELECT count(*) AS days, {r('avg(long_net) * 1e4=>one_bp', 'avg(short_net) * 1e4=>other_bp', 'avg(short_net - long_net) * 1e4=>lead_bp')} FROM two WHERE long_net IS NOT NULL AND short_net IS NOT NULL", _TWO))
def lead_over(spark, d):
    return tidy(second_stage.lead_over(_two(scores(spark, d)), "long_net", "short_net"))


@query()
def nested_evaluation(spark, d):
    """Intervals and verdicts of the second stage's arms on blocks of days later than its training."""
    x, _ = _learning(spark, d)
    x = ranking.ranked(x).withColumn("net", net_return())
    picks = second_stage.nested_picks(x.where("rk <= 10"), ["p_raw", "p_short", "ret5", "gapvol20"])
    arms = second_stage.nested_books(second_stage.decided_picks(picks))
    return evidence.decided(evidence.block_bootstrap(arms, [c for c in arms.columns if c != "ts"]))


def _run(spark, d, x, s, runs: dict[str, list[str]]):
    """Intervals of two runs and of their difference over the same test days."""
    one, other = runs
    folds = splits.forward_blocks(sessions(s))
    daily = second_stage.compared_runs(x, folds, runs).withColumn("difference", F.col(other) - F.col(one))
    return evidence.decided(evidence.block_bootstrap(daily, [one, other, "difference"]))


@query()
def ablation(spark, d):
    """The same walk-forward with all features and without the score."""
    x, s = _learning(spark, d)
    return _run(spark, d, x, s, {"whole": ["p_short", "ret5", "gapvol20"], "without_score": ["ret5", "gapvol20"]})


@query()
def ab_run(spark, d):
    """The same walk-forward without and with each symbol's own record, matched as of the session."""
    b = stored_bars(spark, d)
    x, s = _learning(spark, d, b)
    record = memories.own_record(_outcomes(labelled(spark, d, b), "ft_a", "xr_a")).select("symbol", "ts", "own_tp", "own_ret")
    joined = panel_features.asof_join(x, record)
    return _run(spark, d, joined, s, {"plain": ["p_short", "ret5"], "with_record": ["p_short", "ret5", "own_tp", "own_ret"]})
