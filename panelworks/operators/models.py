"""Walk-forward classifiers, isotonic calibration and bagged second-stage models.

Boosted trees (``boosting``) take missing features as they are. The forests and linear models of
pyspark.ml reject them; for these, features are filled with zero and flagged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.operators import boosting
from panelworks.operators.isotonic import calibrated, isotonic
from panelworks.operators.sampling import capped_sample
from panelworks.operators.splits import day_blocks, hashed_bags, hashed_days, held_out
from panelworks.sources.durable import durable
from panelworks.sources.tables import assert_no_label_leak


@dataclass(frozen=True)
class Trees:
    rounds: int = 300
    depth: int = 5
    rate: float = 0.06
    leaf: int = 200
    fit_cap: int = 400_000
    seed: int = 7
    l2: float = 1.0

    def boosting(self, loss: str) -> boosting.Boosting:
        return boosting.Boosting(self.rounds, self.depth, self.rate, self.leaf, self.l2, loss)


FACTORIES = {
    "forest": lambda c: RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=c.rounds, maxDepth=c.depth, minInstancesPerNode=c.leaf, seed=c.seed),
    "logistic": lambda c: LogisticRegression(featuresCol="features", labelCol="label", regParam=0.01),
}


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``features``: each feature with NULL as zero, then its missing flags."""
    assert_no_label_leak(features)
    filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features} | {f"_m_{c}": F.col(c).isNull().cast("double") for c in features})
    out = VectorAssembler(inputCols=[*(f"_f_{c}" for c in features), *(f"_m_{c}" for c in features)], outputCol="features").transform(filled)
    return out.drop(*(f"_f_{c}" for c in features), *(f"_m_{c}" for c in features))


def prepared(df: DataFrame, features: list[str], kind: str) -> DataFrame:
    """``df`` as the kind of model needs it: boosted trees read the features themselves."""
    assert_no_label_leak(features)
    return df if kind == "gbt" else assembled(df, features)


META_TREES = Trees(rounds=150, depth=3, rate=0.05, leaf=100, l2=2.0)  # of the second stage


def fit_classifier(train: DataFrame, kind: str = "gbt", cfg: Trees = Trees(), features: list[str] | None = None):
    """``train`` is ``prepared``; of an ``assembled`` one the features are known. Kinds: gbt, forest, logistic."""
    if kind != "gbt":
        return FACTORIES[kind](cfg).fit(train)
    if features is None:
        names = [a["name"] for kinds in train.schema["features"].metadata["ml_attr"]["attrs"].values() for a in kinds]
        features = [n[3:] for n in names if n.startswith("_f_")]
    return boosting.fit(train, features, "label", cfg.boosting("log"))


def fit_classifiers(parts: list[DataFrame], features: list[list[str]], kind: str = "gbt", cfg: Trees = Trees()) -> list:
    """A classifier of each of several ``prepared`` tables with its features; boosted ones grow side by side."""
    if kind != "gbt":
        return [fit_classifier(train, kind, cfg, names) for train, names in zip(parts, features, strict=True)]
    return boosting.fit_each([(train, boosting.Fit(list(names))) for train, names in zip(parts, features, strict=True)], cfg.boosting("log"))


def probability(model, df: DataFrame, out: str = "p_raw") -> DataFrame:
    if isinstance(model, boosting.Model):
        return df.withColumn(out, model.score(df.sparkSession))
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def fit_regressor(train: DataFrame, features: list[str], cfg: Trees = Trees()) -> boosting.Model:
    """Absolute-error boosting: the typical value, not the average."""
    return boosting.fit(train, features, "label", cfg.boosting("absolute"))


def walk_forward(df: DataFrame, folds: DataFrame, features: list[str], kind: str = "gbt", cfg: Trees = Trees()) -> DataFrame:
    """Scores of each fold's test block by a model of its training days. One fit per fold, folds are a handful."""
    return walk_forwards(df, folds, [features], kind, cfg)[0]


def walk_forwards(df: DataFrame, folds: DataFrame, runs: list[list[str]], kind: str = "gbt", cfg: Trees = Trees()) -> list[DataFrame]:
    """``walk_forward`` by each of several lists of features over the same folds; fits grow side by side."""
    blocks, trains, tests = folds.orderBy("block").collect(), [], []
    for features in runs:
        data = durable(prepared(df, features, kind))
        for f in blocks:
            train = data.where(F.col("ts") <= F.lit(f["train_end"])).where("label is not null")
            trains.append(capped_sample(train, "key", cfg.fit_cap, cfg.seed) if "key" in df.columns else train)
            tests.append(data.where(F.col("ts").between(F.lit(f["test_start"]), F.lit(f["test_end"]))).withColumn("fold", F.lit(f["block"]).cast("long")))
    fitted = fit_classifiers(trains, [features for features in runs for _ in blocks], kind, cfg)
    scored = [probability(m, test).drop("features") for m, test in zip(fitted, tests, strict=True)]
    return [reduce(lambda a, b: a.unionByName(b), scored[k * len(blocks) : (k + 1) * len(blocks)]) for k in range(len(runs))]


def calibrated_by_earlier_folds(scored: DataFrame, score: str = "p_raw", y: str = "label") -> DataFrame:
    """Adds ``conf_cf``: each fold's calibration fitted on earlier folds only; NULL in the first."""
    folds = sorted(r["fold"] for r in scored.select("fold").distinct().collect())
    parts = [scored.where(F.col("fold") == folds[0]).withColumn("conf_cf", F.lit(None).cast("double"))]
    for f in folds[1:]:
        model = isotonic(scored.where((F.col("fold") < f) & F.col(y).isNotNull()), score, y)
        parts.append(calibrated(model, scored.where(F.col("fold") == f), score, "conf_cf"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def bagged(df: DataFrame, sessions: DataFrame, features: list[str], bags: int = 10, share: float = 0.8, kind: str = "forest", cfg: Trees = META_TREES) -> list:
    """Members fitted on whole days each."""
    return bagged_each([(df, sessions, bags)], features, share, kind, cfg)[0]


def bagged_each(groups: list[tuple[DataFrame, DataFrame, int]], features: list[str], share: float = 0.8, kind: str = "forest", cfg: Trees = META_TREES) -> list[list]:
    """``bagged`` of several (rows, sessions, bags); boosted members of all groups grow side by side."""
    if kind != "gbt":
        out = []
        for df, sessions, bags in groups:
            data = durable(prepared(df.where("label is not null"), features, kind))
            out.append([fit_classifier(data.join(F.broadcast(hashed_days(sessions, share, b)), "ts", "left_semi"), kind, cfg, features) for b in range(bags)])
        return out
    assert_no_label_leak(features)
    both = lambda frames: durable(reduce(lambda a, b: a.unionByName(b), frames))
    rows = both([df.where("label is not null").select(F.lit(g).alias("_group"), "ts", F.col("label").cast("double").alias("_y"), *features) for g, (df, _, _) in enumerate(groups)])
    days = both([sessions.select(F.lit(g).alias("_group"), "ts") for g, (_, sessions, _) in enumerate(groups)])
    members = [(g, b) for g, (_, _, bags) in enumerate(groups) for b in range(bags)]
    bags = rows.sparkSession.createDataFrame([(k, g, b) for k, (g, b) in enumerate(members)], "_fit int, _group int, _bag int")
    taken = durable(hashed_bags(days.join(F.broadcast(bags), "_group"), share))
    fitted = boosting.fit_all(rows.join(F.broadcast(taken), ["_group", "ts"]), {k: boosting.Fit(list(features)) for k in range(len(members))}, cfg.boosting("log"))
    return [[fitted[k] for k, (of, _) in enumerate(members) if of == g] for g in range(len(groups))]


def bag_predictions(members: list, df: DataFrame, features: list[str], iso=None) -> DataFrame:
    """Adds ``meta_p`` (mean of the members) and ``spread_lo``/``spread_hi``, their 10th and 90th percentiles; all calibrated by ``iso`` if given."""
    if all(isinstance(m, boosting.Model) for m in members):
        d = df.withColumn("_all", boosting.scores(df.sparkSession, members))
        d = d.withColumns({f"_p{b}": F.col("_all")[b] for b in range(len(members))}).drop("_all")
    else:
        d = assembled(df, features)
        for b, m in enumerate(members):
            d = probability(m, d, f"_p{b}")
    d = d.withColumn("meta_p", sum((F.col(f"_p{b}") for b in range(len(members))), F.lit(0.0)) / len(members))
    if iso is not None:
        for c in ("meta_p", *[f"_p{b}" for b in range(len(members))]):
            d = calibrated(iso, d, c, c)
    each = F.array(*[F.col(f"_p{b}") for b in range(len(members))])
    d = d.withColumn("_each", F.array_sort(each))
    n = len(members)

    def quantile(q: float):
        at = q * (n - 1)
        low = int(at)
        return F.col("_each")[low] + (F.col("_each")[min(low + 1, n - 1)] - F.col("_each")[low]) * (at - low)

    return d.withColumns({"spread_lo": quantile(0.1), "spread_hi": quantile(0.9)}).drop("features", "_each", *[f"_p{b}" for b in range(n)])


BUNDLE = ("TP", "SL", "MFE", "MAE", "DAYS")


def fit_bundle(train: DataFrame, features: list[str], cfg: Trees = Trees()) -> dict:
    """Five models of the same features: target first, stop first, best and worst excursion, sessions to the target.

    ``train`` has key, ft, mfe, mae and days_tp. Rows without an outcome do not count; sessions are
    learnt from rows whose target came first. At most ``fit_cap`` rows each, the first by a hash of the key.
    """
    return fit_bundles([train], features, cfg)[0]


def fit_bundles(trains: list[DataFrame], features: list[str], cfg: Trees = Trees()) -> list[dict]:
    """``fit_bundle`` of several tables; all their models grow side by side."""
    assert_no_label_leak(features)
    parts = []
    labelled = lambda df, c: df.withColumn("label", c.cast("double")).where("label is not null")
    for train in trains:
        data = durable(train.where("ft is not null").select("key", "ft", "mfe", "mae", "days_tp", *features))
        rows = capped_sample(data, "key", cfg.fit_cap, cfg.seed)
        reached = capped_sample(data.where("ft = 1 and days_tp is not null"), "key", cfg.fit_cap, cfg.seed)
        learnt = {"TP": (rows, F.col("ft") == 1, "log"), "SL": (rows, F.col("ft") == -1, "log"), "MFE": (rows, F.col("mfe"), "absolute"), "MAE": (rows, F.col("mae"), "absolute"), "DAYS": (reached, F.col("days_tp"), "absolute")}
        parts += [(labelled(df, c), boosting.Fit(list(features), loss)) for df, c, loss in (learnt[name] for name in BUNDLE)]
    fitted = boosting.fit_each(parts, cfg.boosting("log"))
    return [dict(zip(BUNDLE, fitted[k : k + len(BUNDLE)], strict=True)) for k in range(0, len(fitted), len(BUNDLE))]


def predict_bundle(bundle: dict, df: DataFrame, features: list[str], horizon: int = 5) -> DataFrame:
    """Adds raw, p_sl, mfe_hat, mae_hat and days_hat, the last within 1 and ``horizon``."""
    outs = {"TP": "raw", "SL": "p_sl", "MFE": "mfe_hat", "MAE": "mae_hat", "DAYS": "days_hat"}
    d = df.withColumns({out: bundle[name].score(df.sparkSession) for name, out in outs.items()})
    return d.withColumn("days_hat", F.greatest(F.lit(1.0), F.least(F.lit(float(horizon)), F.col("days_hat"))))


def save_bundle(bundle: dict, path: str) -> None:
    for name in BUNDLE:
        bundle[name].save(SparkSession.active(), f"{path}/{name}")


def load_bundle(path: str) -> dict:
    return {name: boosting.Model.load(SparkSession.active(), f"{path}/{name}") for name in BUNDLE}


@dataclass(frozen=True)
class Meta:
    members: list
    iso: object
    tau: float


def fit_meta(df: DataFrame, sessions: DataFrame, features: list[str], **fit) -> Meta:
    """A bagged classifier, calibrated on scores that its training rows had not seen; ``fit`` as in ``fit_metas``."""
    return fit_metas([(df, sessions)], features, **fit)[0]


def fit_metas(parts: list[tuple[DataFrame, DataFrame]], features: list[str], top: int = 3, skip: float = 0.30, bags: int = 10, oof_bags: int = 3, blocks: int = 5, kind: str = "gbt", cfg: Trees = META_TREES) -> list[Meta]:
    """``fit_meta`` of several (rows, sessions); boosted members of all grow side by side.

    Each block of days is scored by members fitted outside its guard band; a block whose training rows
    hold a single class is left out. The cut ``tau`` is the ``skip`` quantile of the calibrated scores of
    the top by ``rk``, 0 if there are none.
    """
    groups, tests = [], []  # tests: which part's rows a group's members score; of the last ones none
    knowns = [durable(df.where("label is not null").select("ts", "symbol", "rk", "label", *features)) for df, _ in parts]
    for k, (known, (_, sessions)) in enumerate(zip(knowns, parts, strict=True)):
        held = [held_out(known, b) for b in day_blocks(sessions, blocks).collect()]  # a handful
        for d in held:
            train, block = d.where("part = 'train'"), d.where("part = 'block'")
            if train.agg(F.count_distinct("label")).first()[0] > 1:
                groups.append((train, train.select("ts").distinct(), oof_bags))
                tests.append((k, block))
        if not any(part == k for part, _ in tests):
            raise ValueError("labels of one class only: nothing to learn")
    fitted = bagged_each(groups + [(known, sessions, bags) for known, (_, sessions) in zip(knowns, parts, strict=True)], features, kind=kind, cfg=cfg)
    out = []
    for k, members in enumerate(fitted[len(groups) :]):
        seen = [bag_predictions(fitted[g], block, features).select("ts", "symbol", "rk", "label", "meta_p") for g, (part, block) in enumerate(tests) if part == k]
        oof = durable(reduce(lambda a, b: a.unionByName(b), seen))
        iso = isotonic(oof, "meta_p", "label")
        tau = calibrated(iso, oof.where(F.col("rk") <= top), "meta_p").agg(F.percentile("p_cal", skip)).first()[0]
        out.append(Meta(members, iso, tau or 0.0))
    return out


def predict_meta(fitted: Meta, df: DataFrame, features: list[str]) -> DataFrame:
    """Adds the calibrated mean of the members and the 10th and 90th percentiles of their calibrated scores.

    The mean is taken before calibration, the percentiles after it.
    """
    return bag_predictions(fitted.members, df, features, fitted.iso)


def importance(members: list, features: list[str], top: int = 8) -> list[tuple[str, float]]:
    """Share of the split gain of each feature over all members, its missing flag included; the largest first."""
    both = np.zeros(len(features))
    for m in members:
        gain = m.gains() if isinstance(m, boosting.Model) else m.featureImportances.toArray()
        both += gain[: len(features)] + (gain[len(features) :] if len(gain) > len(features) else 0.0)
    if both.sum() <= 0:
        return []
    return sorted(zip(features, (both / both.sum()).tolist()), key=lambda x: (-x[1], x[0]))[:top]
