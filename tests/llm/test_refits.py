"""The quality classifier fitted again in plain numpy; pipeline stages on odd tables; op8 on whole tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelworks.llm import quality_classifier as Q
from panelworks.llm.line_dedup import Lines, removed_lines
from tests.llm import brute


def test_quality_scores_like_a_plain_refit(spark, sf):
    cfg = Q.Settings()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(cfg.folds)).alias("fold")).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stats = []
    for r in docs:
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        stats.append(Q.statistics(data, np.array([0, len(data)]))[0].astype(np.float32))
    stats = np.array(stats, float)
    use = [i for i, r in enumerate(docs) if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x, y, fold = stats[use], np.array([labels[docs[i].doc_id] for i in use], float), np.array([docs[i].fold for i in use])
    centre, spread = x.mean(0), x.std(0)
    spread[spread <= 1e-9] = 1.0
    rng = np.random.default_rng(cfg.seed)
    way, turn = rng.normal(size=(x.shape[1], cfg.features)) / cfg.width, rng.uniform(0, 2 * np.pi, cfg.features)

    def lifted(s):
        z = np.sqrt(2 / cfg.features) * np.cos(np.clip((s - centre) / spread, -8, 8) @ way + turn)
        return np.column_stack([z, np.ones(len(z))])

    def ridge(z, t):
        return np.linalg.solve(z.T @ z + cfg.ridge * 1e-3 * np.eye(z.shape[1]), z.T @ t)

    z = lifted(x)
    out_of_fold = np.array([lifted(x[i : i + 1])[0] @ ridge(z[fold != fold[i]], y[fold != fold[i]]) for i in range(len(y))])
    bins = np.clip((out_of_fold + 1) / 3 * cfg.bins, 0, cfg.bins - 1).astype(int)
    at = np.unique(bins)
    n, ones = np.array([(bins == b).sum() for b in at]), np.array([y[bins == b].sum() for b in at])
    blocks = []
    for k in range(len(at)):
        blocks.append([[k], ones[k], n[k]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    level = np.array([s / m for ks, s, m in blocks for _ in ks])
    base = (y.sum() + 0.5) / (len(y) + 1)
    want = np.clip(np.interp(lifted(stats) @ ridge(z, y), (at + 0.5) / cfg.bins * 3 - 1, (level * len(at) + base) / (len(at) + 1)), 0, 1)
    got = {r.doc_id: r for r in Q.op3_quality_classifier(spark, sf).collect()}
    apart = np.array([abs(got[r.doc_id].score - w) for r, w in zip(docs, want, strict=True)])
    assert np.quantile(apart, 0.9) < 1e-4 and apart.max() < 0.1  # a score at a bin's edge may fall to either side


def test_lines_of_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 4_000).select("doc_id", F.xxhash64("text").alias("twin"), "text")
    got = {r.doc_id: set(r.removed) for r in removed_lines(docs, Lines()).collect()}
    assert got == {i: k for i, k in brute.removed_lines([(r.doc_id, r.text) for r in docs.collect()]).items() if k}


@pytest.mark.parametrize("which", ["edges", "nothing"])
def test_stages_take_odd_tables(spark, sf, which, edges, nothing):
    docs = {"edges": edges, "nothing": nothing}[which]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "piece_encoding":
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        else:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if which == "nothing":
            assert out.count() == 0
        elif name in ("toxicity", "line_dedup", "piece_encoding"):
            assert out.count() == docs.count()
        elif name == "near_dedup":
            kept = sorted(map(repr, (r.doc_id for r in out.where("text is null or text rlike '^\\\\s*$'").collect())))
            assert kept == sorted(map(repr, (r.doc_id for r in docs.where("text is null or text rlike '^\\\\s*$'").collect())))
