"""The ten operators against brute force, on edge cases and on empty tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.llm import language_id, line_dedup, linking, mixing, near_dedup, piece_encoding, quality_classifier, quality_rules, suffix_dedup, text_kernels, top_k, toxicity
from panelworks.llm.components import components
from panelworks.llm.registry import QUERIES
from tests.llm import brute


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# 1


def test_top_k_against_all_products(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(300, 6)) * 3)
    v[50:80] = v[50]  # ties
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, 2.0])], "vec_id long, v array<double>")
    got = defaultdict(list)
    for r in top_k.top_k(rows, rows.where("vec_id % 20 = 0"), top_k.Search(k=7, shard_rows=64, block_queries=5, leaf=8)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 300, 20):
        want = sorted(((int(v[i] @ v[q]), i) for i in range(300) if i != q), key=lambda x: (-x[0], x[1]))[:7]
        assert got[q] == [(i, s) for s, i in want]


def test_top_k_edges(spark):
    rows = spark.createDataFrame([(0, [1e18, 1.0]), (1, [1e18, -1.0]), (2, [float("inf"), 0.0]), (3, [None, 1.0]), (4, None), (None, [1.0, 1.0]), (0, [1e18, 1.0]), (5, [])], "vec_id long, embedding array<double>").withColumn("v", top_k.quantised())
    got = [(r.query_id, r.vec_id, r.score) for r in top_k.top_k(rows, rows.where("vec_id = 0")).collect()]
    assert got == [(0, 1, (1 << 63) - 1)]
    assert top_k.top_k(rows.where("vec_id > 9"), rows.where("vec_id > 9")).count() == 0


def test_top_k_opens_few_leaves_of_clustered_vectors():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(50, 32)) * 60
    v = np.round(centres[rng.integers(0, 50, 4000)] + rng.normal(size=(4000, 32)) * 6)
    tree, ids, asks, scored = top_k.BallTree(v, 32), np.arange(4000), np.arange(0, 4000, 20), []
    place, got, scores = top_k.search_shard(tree, ids[tree.order], v[tree.order], asks, v[asks], np.full(200, -1e300), top_k.Search(), scored)
    assert sum(scored) < 0.25 * 4000 * 200
    for j, q in enumerate(asks):
        want = sorted((-int(v[i] @ v[q]), i) for i in ids if i != q)[:20]
        assert [(-s, i) for i, s in zip(got[place == j], scores[place == j], strict=True)] == want


def test_top_k_floors_prune_and_columns_may_clash(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(400, 3)) * 30)
    tree, ids, few, many = top_k.BallTree(v, 8), np.arange(400), [], []
    true = np.sort(v[:20] @ v.T, axis=1)[:, -5]
    for floors, scored in ((true, few), (np.full(20, -1e300), many)):
        top_k.search_shard(tree, ids[tree.order], v[tree.order], np.arange(20), v[:20], floors, top_k.Search(k=5), scored)
    assert sum(few) <= sum(many) < 400 * 20
    rows = spark.createDataFrame([(i, x.tolist(), 1, 2, 3, 4.0) for i, x in enumerate(v)], "vec_id long, v array<double>, q long, shard int, width int, floor double")
    got = top_k.top_k(rows, rows.where("vec_id < 3"), top_k.Search(k=2, shard_rows=50, waves=(1, 2))).orderBy("query_id", "rank").collect()
    for q in range(3):
        want = sorted((-int(v[i] @ v[q]), i) for i in range(400) if i != q)[:2]
        assert [(-r.score, r.vec_id) for r in got if r.query_id == q] == want


# 2


def test_quality_rules_base_counts(spark, edges, nothing):
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(edges).collect())
    assert got == sorted((i or 0, *brute.base_facts(t)) for i, t in texts(edges))
    assert quality_rules.quality_rules(nothing).count() == 0
    assert quality_rules.quality_rules(edges.withColumn("lang", F.lit(None).cast("string"))).where("kept and base_failed").count() == 0


def test_js_distance_by_hand():
    got = quality_rules.js_distance(np.array([[1, 0], [1, 1], [0, 0]]), np.array([0.0, 5.0]))
    m = 0.5 * (0.5 * math.log2(0.5 / 0.25) + 0.5 * math.log2(0.5 / 0.75)) + 0.5 * math.log2(1 / 0.75)
    assert np.allclose(got, [1.0, math.sqrt(m), 0.0])


def test_quality_rules_reject_junk_and_keep_prose(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.op2_quality_rules(spark, sf).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in got}
    assert share[1] > 0.98 and share[0] < 0.35


# 3, 4, 10


def auc(rows):
    ones, zeros = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_quality_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_classifier.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert auc([(r.score, r.quality) for r in got]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_pool_adjacent_is_monotone_and_keeps_sums():
    v, w = np.array([0.1, 0.5, 0.2, 0.9, 0.4]), np.array([1.0, 2, 1, 1, 3])
    level = quality_classifier.pool_adjacent(v, w)
    assert (np.diff(level) >= 0).all() and math.isclose(level @ w, v @ w)


def test_trained_operators_on_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, 1), (6, 0), (7, None), (None, 1), (11, 0)], "doc_id long, quality int").withColumn("toxic", F.col("quality"))
    for learn in (labels, labels.where("quality = 1"), labels.where("quality > 9")):
        got = quality_classifier.classify_quality(edges, learn, F.lit(True)).collect()
        assert len(got) == edges.count() and all(0 <= r.score <= 1 for r in got)
        model = toxicity.fit(edges, learn, F.lit(True))
        got = toxicity.score_toxicity(edges, model).collect()
        assert len(got) == edges.count() and all(0 <= r.score <= 1 for r in got)
        assert set(toxicity.keep_clean(edges, model, 2.0).columns) == set(edges.columns)
    assert quality_classifier.classify_quality(nothing, labels, F.lit(True)).count() == 0
    assert toxicity.score_toxicity(nothing, toxicity.fit(nothing, labels, F.lit(True))).count() == 0


def test_language_code_lengths_are_exact(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund saß auf der matte", "de"), (3, "the dog", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language_id.learn(df, language_id.Settings(order=3))
    probes = ["the hat", "", "saß", "zzz", "t", "der kat\x00"]
    column = text_kernels.pa.array(probes)
    data, at = text_kernels.utf8(column)
    bits = trees.code_lengths(data, at)
    for j, lang in enumerate(trees.langs):
        counts = defaultdict(Counter)
        for _, t, own in rows:
            b = t.encode()
            for i in range(len(b)):
                for k in range(min(3, i) + 1):
                    counts[b[i - k : i]][b[i]] += own == lang
        counts = {c: {b: n for b, n in x.items() if n} for c, x in counts.items()}
        counts = {c: x for c, x in counts.items() if x}
        for p, got in zip(probes, bits[:, j], strict=True):
            assert math.isclose(got, brute.ppm_bits(p, counts, 3), rel_tol=1e-4, abs_tol=1e-3)


def test_languages_of_held_out_documents(spark, edges, nothing):
    sf = "/root/testdata/sf0.01"
    got = language_id.op4_language_id(spark, sf).join(documents(spark, sf).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    pred = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_language(edges, edges).collect()}
    assert pred[1] == pred[2] == pred[3] == pred[11] == ("und", 0.0) and pred[9][0] != "und"
    assert language_id.identify_language(nothing, nothing).count() == 0
    assert {r.lang_pred for r in language_id.identify_language(edges, nothing).collect()} == {"und"}


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert auc([(r.score, r.toxic) for r in got]) > 0.94
    assert sum(r.predicted for r in got if not r.toxic) / len(got) < 0.02


def test_ngrams_stay_in_words_and_texts():
    s = toxicity.Settings(orders=(3,))
    data, at = text_kernels.utf8(text_kernels.pa.array(["ab", "", "éa b", None]))
    (owner, feature), = toxicity.ngrams(data, at, s)
    assert sorted(owner.tolist()) == [0, 0, 2, 2, 2]  # " ab" "ab " / " éa" "éa " " b "
    assert len(set(feature.tolist())) == 5


# 5


@pytest.mark.parametrize("spans", [suffix_dedup.Spans(length=10, seed=5, batch=50, flush=100, hot=20), suffix_dedup.Spans(length=10, seed=4, hot=2), suffix_dedup.Spans(length=13, seed=3)])
def test_suffix_dedup_against_all_windows(spark, spans):
    rng = random.Random(3)
    rows = [(i * 7 % 151, "".join(rng.choice("ab é") for _ in range(rng.randint(0, 70))) if i % 4 else "aaaaaaaaaabaaaaaaaaaaaaaaaaa"[: rng.randint(1, 28)]) for i in range(151)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_spans(df, spans).collect()}
    assert got == brute.repeated_bytes(rows, spans.length)


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for n in [*range(1, 25), 400]:
        for kinds in (1, 2, 5):
            t = rng.integers(1, kinds + 1, n)
            assert suffix_dedup.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_suffix_dedup_edges(spark, edges, nothing):
    unique = edges.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_spans(unique).collect()}
    assert got == brute.repeated_bytes(texts(unique), 100)
    every = suffix_dedup.dedup_spans(edges, with_text=True)
    assert every.count() == edges.count() and every.where("doc_id is null and n_removed > 0").count() == 0
    assert every.where("doc_id = 6").select("n_removed").distinct().count() == 1  # equal rows are treated alike
    assert suffix_dedup.dedup_spans(nothing).count() == 0


# 6


def test_targets_share_the_excess():
    got = mixing.targets([100, 1000, 1000], mixing.Plan())
    assert got[0] == 200 and math.isclose(sum(got), 1.5 * 2100) and math.isclose(got[2], 2 * got[1]) and all(t <= 2 * s for t, s in zip(got, [100, 1000, 1000], strict=True))
    assert mixing.targets([0, 0], mixing.Plan()) == [0.0, 0.0] and mixing.targets([], mixing.Plan()) == []


def test_splitting_tree_hands_out_each_block_once():
    quotas = np.array([17, 0, 301, 5])
    spans = [mixing.split(quotas, 7, s, 1) for s in range(7)]
    for k, q in enumerate(quotas):
        assert sorted(x for a, n in spans for x in range(a[k], a[k] + n[k])) == list(range(q))
    assert max(n.sum() for _, n in spans) - min(n.sum() for _, n in spans) <= 3


def test_mixing_meets_targets(spark, sf, edges, nothing):
    got = mixing.op6_mixing(spark, sf)
    again = mixing.op6_mixing(spark, sf)
    assert sorted(got.collect()) == sorted(again.collect())
    docs = documents(spark, sf)
    size = {i: len((t or "").encode().split()) for i, t in texts(docs)}
    rows = got.join(docs.select("doc_id", "source"), "doc_id").collect()
    assert all(r["size"] == size[r.doc_id] and r.taken <= 2 * r["size"] for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        near = max(r["size"] for r in own)  # within one document
        assert sum(r["size"] for r in own) == own[0].source_size and abs(sum(r.taken for r in own) - own[0].target) <= near
    mixed = mixing.mix(docs, mixing.Plan(shard_words=5000, block_words=500))
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.select("mix_shard").distinct().count() > 3 and max(copies.values()) <= 2
    out = mixing.mix(edges)
    assert out.columns == [*edges.columns, "mix_shard", "mix_place"] and out.count() > 0
    assert mixing.mix(nothing).count() == 0


def test_the_tree_decides_what_is_taken(spark, sf, monkeypatch):
    docs = documents(spark, sf)
    plan = mixing.Plan(block_words=500, shard_words=5000)
    before = mixing.draw(docs, plan)[1].collect()
    shards = {r.shard for r in before}
    assert len(shards) > 3
    monkeypatch.setattr(mixing, "split", lambda quotas, shards, shard, seed: (np.zeros(len(quotas), np.int64), np.zeros(len(quotas), np.int64)))
    with pytest.raises(Exception, match="handed to no shard"):
        mixing.draw(docs, plan)[1].collect()


def test_mixing_targets_against_sql(spark, sf):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    words = "len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))"
    sizes = {s: (n, k) for s, n, k in duck.sql(f"SELECT source, sum({words}), row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 FROM documents GROUP BY source").fetchall()}
    left, open_, want = 1.5 * sum(n for n, _ in sizes.values()), dict(sizes), {}
    while open_:
        weight = {s: (3, 1, 2)[k % 3] for s, (_, k) in open_.items()}
        full = [s for s in open_ if left * weight[s] / sum(weight.values()) > 2 * sizes[s][0]]
        want |= {s: 2.0 * sizes[s][0] for s in full} if full else {s: left * w / sum(weight.values()) for s, w in weight.items()}
        left -= sum(want[s] for s in full)
        open_ = {s: x for s, x in open_.items() if full and s not in full}
    size = dict(duck.sql(f"SELECT doc_id, {words} FROM documents").fetchall())
    for r in mixing.op6_mixing(spark, sf).join(documents(spark, sf).select("doc_id", "source"), "doc_id").collect():
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[r.source][0] and math.isclose(r.target, want[r.source])
        assert r.taken == r["size"] * len(r.shards or ()) and len(r.shards or ()) <= 2


def test_mix_holds_every_draw(spark):
    words = lambda k: " ".join(["w"] * (k % 9 + 1)) + f" {k}"
    rows = [(k if k % 3 else None, words(k), "a") for k in range(60)] + [(7, words(90), "a"), (None, "x y", None), (None, "x y", None), (5, words(5), "a"), (None, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    sizes, drawn = mixing.draw(df)
    want = drawn.join(sizes, "row").groupBy("doc_id", "source", "size").count().collect()
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", " "))).cast("long")
    got = mixing.mix(df).withColumn("size", size).groupBy("doc_id", "source", "size").count().collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(r.doc_id is None for r in want)


# 7


def near_pairs(rng, n=60):
    words = [f"w{k}" for k in range(300)]
    rows = []
    for g in range(n // 6):
        base = [rng.choice(words) for _ in range(60)]
        for j in range(6):
            w = list(base)
            for _ in range(j):
                w[rng.randrange(60)] = rng.choice(words)
            rows.append((g * 6 + j, " ".join(w)))
    return rows


@pytest.mark.parametrize("small", [32, 2])
def test_near_dedup_against_all_pairs(spark, small):
    rows = near_pairs(random.Random(8))
    near = near_dedup.Near(width=3, similarity=linking.Similarity(percent=85, small=small, block=3))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), near).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute.near(rows, 3, 85).items()}


def test_near_dedup_on_documents_and_edges(spark, sf, edges, nothing):
    docs = documents(spark, sf)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.op7_near_dedup(spark, sf).collect()}
    assert got == brute.near(texts(docs), 3, 85)
    rows = near_dedup.near_duplicates(edges).collect()
    assert len(rows) == edges.count() and all(r.kept for r in rows if r.n_shingles == 0 or r.doc_id is None)
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    kept = near_dedup.keep_one(edges)
    assert kept.columns == edges.columns and kept.where("doc_id = 5").count() == 0 and kept.where("text is null").count() == 2
    assert near_dedup.keep_one(nothing).count() == 0


def test_near_dedup_follows_every_text_of_a_repeated_id(spark):
    rng = random.Random(6)
    a, b = ([f"w{rng.randrange(5000)}" for _ in range(60)] for _ in range(2))
    rows = [(1, a), (1, b), (2, [*a, "x"]), (3, [*b, "y"]), (4, [*b, "y", "z"])]
    got = near_dedup.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert len(got) == 5 and {r.component_id for r in got} == {1}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7), (None, 3)], "a long, b long").repartition(7)
    got = {r.id: r.label for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_pruning_keeps_similar_pairs():
    s = linking.Similarity(percent=80)
    least = linking.least_matches(s)
    n = s.values
    tail = sum(math.comb(n + 1, m) * 0.8**m * 0.2 ** (n + 1 - m) for m in range(least[n]))
    assert tail < s.verify_miss <= tail + math.comb(n + 1, int(least[n])) * 0.8 ** least[n] * 0.2 ** (n + 1 - least[n])


def test_bytes_that_agree_by_chance_hide_no_pair():
    rng, near = random.Random(2), near_dedup.Near(width=3, similarity=linking.Similarity(percent=85))
    pairs = []
    for _ in range(2500):
        base = [f"w{rng.randrange(5000)}" for _ in range(60)]
        other = [*base[:20], f"v{rng.randrange(5000)}", *base[21:]]
        pairs.append((" ".join(base), " ".join(other)))
    batch = text_kernels.pa.RecordBatch.from_pydict({"id": list(range(5000)), "text": [t for p in pairs for t in p]})
    rows = text_kernels.pa.Table.from_batches(near_dedup._profile(near)(iter([batch]))).to_pandas().sort_values("id", ignore_index=True)
    sets = near_dedup._expand(near)(text_kernels.pa.array(rows["body"], text_kernels.pa.binary()))
    s = near.similarity
    values = linking.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1], s.values)
    keys, low = linking.band_keys(values, s), values.astype(np.uint8)[:, : s.rows * s.bands].reshape(-1, s.bands, s.rows)
    shared = keys[::2] == keys[1::2]
    early = (low[::2] == low[1::2]).all(2).argmax(1) < shared.argmax(1)
    hard = np.flatnonzero(early & shared.any(1))
    assert len(hard)
    across = linking._across(s, near_dedup._expand(near))
    for k in hard:
        pair = rows.iloc[[2 * k, 2 * k + 1]].assign(lo=0, hi=0, own=0, label=[2 * k, 2 * k + 1])
        found = [len(across(pair.assign(bucket=keys[2 * k, b]))) for b in np.flatnonzero(shared[k])]
        assert found == [1] + [0] * (len(found) - 1)


# 8


def test_line_dedup_against_all_pairs(spark, sf, nothing):
    docs = documents(spark, sf).where("doc_id < 90")
    rows = texts(docs)
    gone = brute.removed_lines(rows)
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.dedup_lines(docs).collect()}
    for i, t in rows:
        want = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert got[i] == (want, len(want) if gone[i] else got[i][1])
    assert sum(map(len, gone.values())) > 20
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_dedup_edges_and_hot_buckets(spark, edges):
    out = line_dedup.dedup_lines(edges, line_dedup.Lines(hot=1, flush=10))
    assert out.columns == edges.columns and out.count() == edges.count()
    got = {r.doc_id: r.text for r in out.where("doc_id is not null").collect()}
    assert got[1] is None and got[2] == "" and got[3] == " \t\n" and got[5] == "" and got[13] == "x\n\n "
    assert out.where("doc_id is null and text is not null").count() == 1
    assert out.where("doc_id = 6").select("text").distinct().count() == 1


# 9


def test_encoding_equals_the_library(spark, sf, edges, nothing):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_encoding.default_model())
    for df in (edges, documents(spark, sf)):
        got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_encoding.encode_documents(df, piece_encoding.default_model()).collect())
        want = []
        for i, t in texts(df):
            ids = model.encode(t or "", add_eos=True)
            want.append((i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
        assert got == sorted(want)
    assert piece_encoding.encode_documents(nothing, piece_encoding.default_model()).count() == 0
    full = piece_encoding.encode_documents(edges.where("doc_id = 9"), piece_encoding.default_model(), with_ids=True).first()
    assert full.ids[-1] == 2 and model.decode(full.ids) == full.decoded


def test_encoding_of_random_strings():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_encoding.default_model())
    codec = piece_encoding.PieceCodec(*piece_encoding.read_vocabulary(piece_encoding.default_model()))
    rng = random.Random(5)
    parts = ["a", "b", "▁", " ", "  ", "é", "\n", "\t", "th", "ing", "0", ".", "==", "--", "漢", "🧿", "int", "ation", "The", "<0x41>", "</s>", "\x00", "ß"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        assert codec.encode(t) == model.encode(t, add_eos=True)


# all


def test_queries_return_their_columns(spark, sf):
    want = {
        "op1": {"query_id", "rank", "vec_id", "score"}, "op2": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op3": {"doc_id", "held_out", "score", "predicted"}, "op4": {"doc_id", "held_out", "lang_pred", "score"}, "op5": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
        "op6": {"doc_id", "size", "source_size", "target", "taken"}, "op7": {"doc_id", "n_shingles", "component_id", "kept"}, "op8": {"doc_id"},
        "op9": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op10": {"doc_id", "held_out", "score", "predicted"},
    }
    assert {n.split("_")[0] for n in QUERIES} == set(want)
    for name, f in QUERIES.items():
        assert want[name.split("_")[0]] <= set(f(spark, sf).columns)
