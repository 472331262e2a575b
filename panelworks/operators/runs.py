"""Training runs: folds and models grown side by side over one stored table, kept under the run's id.

A run's folder holds its scores, its report tables and its models; the log beside it tells runs apart, so
that later work finds the newest. The id is a hash of what was learnt from, hence repeating a run
replaces it. Everything in a report is a relational function of the stored scores.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.functions import net_return
from panelworks.operators import books, evaluation, evidence, models, ranking, second_stage, splits
from panelworks.operators.isotonic import Isotonic, calibrated, isotonic
from panelworks.operators.sampling import capped_sample
from panelworks.sources.durable import durable
from panelworks.sources.tables import assert_no_label_leak, sessions


@dataclass(frozen=True)
class Settings:
    folds: int = 5
    least: float = 0.35  # of the sessions, before the first fold is tested
    embargo: int = 5
    tail: float = 0.25  # of a fold's training sessions, for calibration
    lockbox: float = 0.15  # of all sessions, kept from research
    breakeven: float = 0.424
    top: int = 20  # ranks of the stored picks
    at_once: int = 4  # folds scored, or second stages fitted, side by side
    trees: models.Trees = field(default_factory=models.Trees)
    meta: dict[str, Any] = field(default_factory=dict)  # of the second stage


@dataclass(frozen=True)
class Run:
    """A run's tables and models under ``folder/run``."""

    spark: SparkSession
    folder: str
    run: str

    def path(self, name: str) -> str:
        return f"{self.folder}/{self.run}/{name}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write_isotonic(self, name: str, model: Isotonic) -> None:
        rows = [(k, float(x), float(v)) for k, (x, v) in enumerate(zip(model.x, model.v, strict=True))]
        self.write(name, self.spark.createDataFrame(rows, "k long, x double, v double"))

    def read_isotonic(self, name: str) -> Isotonic:
        rows = sorted(self.read(name).collect())  # a fit's steps
        return Isotonic(np.array([r["x"] for r in rows]), np.array([r["v"] for r in rows]))


def run_id(kind: str, features: list[str], through: object, settings: Settings) -> str:
    known = {"kind": kind, "features": features, "through": str(through), "settings": asdict(settings)}
    return hashlib.sha1(json.dumps(known, sort_keys=True).encode()).hexdigest()[:10]


def logged(run: Run, kind: str, through: object) -> Run:
    books.append_experiment(run.spark, f"{run.folder}/log", {"run": run.run, "kind": kind, "through": through, "at": dt.datetime.now(dt.timezone.utc).isoformat()})
    return run


def newest(spark: SparkSession, folder: str, kind: str) -> Run:
    """The run of a kind trained through the latest session; of several the one made last."""
    rows = spark.read.json(f"{folder}/log").where(F.col("kind") == kind).orderBy(F.desc("through"), F.desc("at")).limit(1).collect()
    if not rows:
        raise ValueError(f"no run of {kind} in {folder}")
    return Run(spark, folder, rows[0]["run"])


def side_by_side(jobs: list[Callable[[], Any]], at_once: int) -> list[Any]:
    """Results of jobs run from several threads, so that small Spark jobs fill the cluster together."""
    if not jobs:
        return []
    session = SparkSession.active()
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(session)(job)) for job in jobs]]


def calibrated_folds(data: DataFrame, folds: DataFrame, features: list[str], settings: Settings = Settings(), kind: str = "gbt") -> DataFrame:
    """(fold, ts, symbol, y, p_raw, p_cal, exit_ret): each fold's test block, scored and calibrated on earlier sessions only.

    A fold's training sessions split into a part to fit on and, after an embargo, a tail whose scores
    calibrate. A fold without rows in one of the three parts is left out. ``data``: ts, symbol, key, label,
    exit_ret, features; folds are a handful.
    """
    rows = durable(models.prepared(data.where("label is not null"), features, kind))
    axis = durable(sessions(rows))

    parts = durable(splits.fold_parts(axis, folds, settings.tail, settings.embargo))

    def of(block: int, part: str) -> DataFrame:
        return rows.join(F.broadcast(parts.where((F.col("block") == block) & (F.col("part") == part)).select("ts")), "ts", "left_semi")  # a row per session

    blocks = [b for b in sorted(r["block"] for r in folds.collect()) if not any(of(b, part).isEmpty() for part in ("fit", "calibrate", "test"))]
    if not blocks:
        raise ValueError("no fold has rows to fit, to calibrate and to test")
    trees = settings.trees
    fitted = models.fit_classifiers([capped_sample(of(b, "fit"), "key", trees.fit_cap, trees.seed) for b in blocks], [features] * len(blocks), kind, trees)

    def fold(block: int, model) -> DataFrame:
        steps = isotonic(models.probability(model, of(block, "calibrate")), "p_raw", "label")
        scored = calibrated(steps, models.probability(model, of(block, "test")), "p_raw", "p_cal")
        return durable(scored.select(F.lit(block).cast("long").alias("fold"), "ts", "symbol", F.col("label").alias("y"), "p_raw", "p_cal", "exit_ret"))

    got = side_by_side([lambda b=b, m=m: fold(b, m) for b, m in zip(blocks, fitted, strict=True)], settings.at_once)
    return reduce(lambda a, b: a.unionByName(b), got)


def score_metrics(x: DataFrame, score: str) -> DataFrame:
    """(score, n, auc, logloss, brier, brier_skill, base_rate, mean_score) of one score against ``y``: one row."""
    auc, loss = evaluation.roc_auc(x, score, "y").select("auc"), evaluation.losses(x, score, "y")
    mean = x.agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))
    return auc.crossJoin(loss).crossJoin(mean).select(F.lit(score).alias("score"), "n", "auc", "logloss", "brier", "brier_skill", "base_rate", "mean_score")


def baseline_tables(scores: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """The report of scored folds: losses before and after calibration, reliability by tenths, cut-offs, hits and evidence of the top."""
    x = scores.withColumns({"hit": F.col("y"), "tie": F.concat_ws("/", "ts", "symbol")})
    return {
        "metrics": score_metrics(x, "p_raw").unionByName(score_metrics(x, "p_cal")),
        "calibration": evaluation.calibration_table(x, "p_cal", "tie"),
        "thresholds": evaluation.threshold_sweep(x, settings.breakeven, "p_cal"),
        "hits": ranking.topn_hit_table(x),
        "evidence": evidence.topn_evidence(x),
    }


def baseline_train(panel: DataFrame, features: list[str], folder: str, settings: Settings = Settings(), kind: str = "gbt") -> Run:
    """The baseline's walk-forward run over the research sessions, stored with its report.

    ``panel``: ts, symbol, key, label, exit_ret, features. The lockbox at the end is never read.
    """
    assert_no_label_leak(features)
    spark = panel.sparkSession
    research = splits.lockbox_parts(sessions(panel), settings.lockbox, settings.embargo).where("part = 'research'").select("ts")
    data = panel.join(F.broadcast(research), "ts", "left_semi")
    axis = sessions(data)
    through = axis.agg(F.max("ts")).first()[0]
    run = Run(spark, folder, run_id("baseline", features, through, settings))
    scores = run.write("scores", calibrated_folds(data, splits.forward_blocks(axis, settings.folds, settings.least, settings.embargo), features, settings, kind))
    for name, table in baseline_tables(scores, settings).items():
        run.write(name, table)
    return logged(run, "baseline", through)


def helper_reliability(x: DataFrame) -> DataFrame:
    """(model, n, spearman, error_model, error_naive, verdict) of the excursions and the sessions to the target."""
    parts = {"MFE": (x, "mfe_hat", "mfe"), "MAE": (x, "mae_hat", "mae"), "DAYS": (x.where("ft = 1"), "days_hat", "days_tp")}
    found = [evaluation.reliability(*p).select(F.lit(name).alias("model"), "*") for name, p in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


def classifier_reliability(x: DataFrame) -> DataFrame:
    """(model, n1, n0, auc, verdict) of the stop-first and target-first scores."""
    parts = {"SL": ("p_sl", F.col("ft") == -1, 0.53), "TP": ("raw", F.col("hit"), 0.5)}
    found = [evaluation.roc_auc(x.withColumn("y", y.cast("long")), score, "y").select(F.lit(name).alias("model"), "n1", "n0", "auc", F.when(F.col("auc") >= least, "useful").otherwise("weak").alias("verdict")) for name, (score, y, least) in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


def engine_tables(scores: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """The engine's report on its validation scores.

    ``scores``: fold, ts, symbol, raw, p_sl, mfe_hat, mae_hat, days_hat and the outcomes ft, hit, exit_ret,
    mfe, mae, days_tp. Confidence of a fold comes from a calibration on earlier folds.
    """
    x = scores.withColumn("p_raw", F.col("raw"))
    daily = ranking.topn_vs_universe(x)
    confident = models.calibrated_by_earlier_folds(x.where("hit is not null"), "p_raw", "hit")
    picks = ranking.ranked(confident).withColumn("net", net_return()).where(F.col("rk") <= settings.top)
    last = confident.join(F.broadcast(x.agg(F.max("fold").alias("fold"))), "fold", "left_semi").withColumn("tie", F.concat_ws("/", "ts", "symbol"))  # one row
    return {
        "picks": picks,
        "universe": daily.select("ts", "universe_net"),
        "rank_stats": ranking.rank_track_record(x),
        "evidence": evidence.block_bootstrap(daily, ["top_net", "universe_net", "excess"]),
        "calibration": evaluation.calibration_table(last.where("conf_cf is not null"), "conf_cf", "tie", y="hit"),
        "reliability": helper_reliability(x),
        "classifiers": classifier_reliability(x),
        "timeouts": x.where("ft = 0").agg(F.avg("exit_ret").alias("timeout_mean"), F.count("*").alias("n")),
    }


def engine_train(panel: DataFrame, features: list[str], folder: str, settings: Settings = Settings(), bars: DataFrame | None = None) -> Run:
    """The engine's run: five models a fold, its report, the second stage on their unseen scores, and the final models.

    ``panel``: ts, symbol, key, ft, hit, exit_ret, mfe, mae, days_tp, features. With ``bars`` the second
    stage is fitted and judged on later blocks of days.
    """
    assert_no_label_leak(features)
    spark, outcomes = panel.sparkSession, ["ft", "hit", "exit_ret", "mfe", "mae", "days_tp"]
    data = durable(panel.where("ft is not null and hit is not null and exit_ret is not null and mfe is not null and mae is not null").select("ts", "symbol", "key", *outcomes, *[c for c in features if c not in outcomes]))
    axis = durable(sessions(data))
    through = axis.agg(F.max("ts")).first()[0]
    run = Run(spark, folder, run_id("engine", features, through, settings))

    folds = splits.forward_blocks(axis, settings.folds, settings.least, settings.embargo).orderBy("block").collect()
    if not folds:
        raise ValueError("too few sessions for a fold")
    *bundles, final = models.fit_bundles([data.where(F.col("ts") <= F.lit(f["train_end"])) for f in folds] + [data], features, settings.trees)

    def scored(f, bundle: dict) -> DataFrame:
        test = data.where(F.col("ts").between(F.lit(f["test_start"]), F.lit(f["test_end"])))
        return models.predict_bundle(bundle, test, features).select(F.lit(f["block"]).cast("long").alias("fold"), "ts", "symbol", "raw", "p_sl", "mfe_hat", "mae_hat", "days_hat", *outcomes)

    models.save_bundle(final, run.path("bundle"))
    run.write("importance", spark.createDataFrame(models.importance([final["TP"]], features, len(features)), "feature string, share double"))
    scores = run.write("scores", reduce(lambda a, b: a.unionByName(b), [scored(f, bundle) for f, bundle in zip(folds, bundles, strict=True)]))
    for name, table in engine_tables(scores, settings).items():
        run.write(name, table)
    run.write_isotonic("isotonic", isotonic(scores, "raw", "hit"))
    if bars is not None:
        _second_stage(run, scores, bars, settings)
    return logged(run, "engine", through)


META = ["p_raw", "score_z", "gap_next", "day_gap_3_4", "top_crowding", "top10_presence5", "form_5", "form_20", "form_60", "ret1", "ret5", "gapvol20", "mk_ret1", "mk_breadth", "mk_dispersion", "mk_vol20"]


def _second_stage(run: Run, scores: DataFrame, bars: DataFrame, settings: Settings) -> None:
    """The second stage on the run's unseen scores: decided picks of later blocks, books, intervals, and the model itself."""
    x = second_stage.meta_features(scores.withColumn("p_raw", F.col("raw")), bars).withColumns({"label": F.col("win").cast("double"), "net": net_return()})
    frame = run.write("meta_features", x)
    fit = {k: v for k, v in settings.meta.items() if k not in ("folds", "nested_least")}
    nested = {"folds": settings.meta.get("folds", 4), "least": settings.meta.get("nested_least", 0.40)}
    picks, final = side_by_side([lambda: second_stage.nested_picks(frame, META, **nested, **fit), lambda: models.fit_meta(frame, sessions(frame), META, **fit)], settings.at_once)
    decided = run.write("meta_picks", second_stage.decided_picks(picks))
    arms = run.write("meta_books", second_stage.nested_books(decided))
    run.write("meta_evidence", evidence.decided(evidence.block_bootstrap(arms, [c for c in arms.columns if c != "ts"])))
    run.write("meta_summary", second_stage.nested_summary(decided))
    run.write("meta_blocks", second_stage.nested_by_block(decided))
    save_meta(run, final)


def save_meta(run: Run, fitted: models.Meta) -> None:
    for k, member in enumerate(fitted.members):
        member.save(run.spark, run.path(f"meta/{k}"))
    run.write_isotonic("meta_isotonic", fitted.iso)
    run.write("meta_cut", run.spark.createDataFrame([(len(fitted.members), float(fitted.tau))], "members int, tau double"))


def load_meta(run: Run) -> models.Meta:
    cut = run.read("meta_cut").first()
    members = [models.boosting.Model.load(run.spark, run.path(f"meta/{k}")) for k in range(cut["members"])]
    return models.Meta(members, run.read_isotonic("meta_isotonic"), cut["tau"])
