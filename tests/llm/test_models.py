"""Search, language model, mixing and quality classifier against brute force, exact figures and held-out labels."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import ball_tree, log_bloom, mixing, weak_labels
from codeloom.llm.sql import mixture as mixture_sql
from tests.llm.samples import documents, frame, prose, words

VECTORS = "vec_id long, embedding array<float>, label int, x string, shard int"


def brute_top(rows, k=10):
    whole = {}
    for n, (i, e, *_) in enumerate(rows):
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            whole[n] = (i, [math.floor(1024 * float(np.float32(x))) for x in e])
    out = set()
    for q, x in whole.values():
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole.values() if i != q and len(y) == len(x))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("shard, block", [(8192, 8192), (40, 2)])
def test_top_k_equals_brute_force(spark, shard, block):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=6).tolist(), 1, "x", 2) for i in range(420)]
    rows += [(1000 + i, [0.5] * 6, 1, "x", 2) for i in range(200)]  # one common vector, more than a leaf of it
    rows += [(1200, rnd.normal(size=6).tolist(), 1, "x", 2)] * 2  # a query that repeats
    rows += [(2000, None, 1, "x", 2), (2001, [1.0, None] * 3, 1, "x", 2), (2002, [float("nan")] * 6, 1, "x", 2),
             (2100, [float("inf")] * 6, 1, "x", 2), (None, [1.0] * 6, 1, "x", 2), (2200, [1.0, 2.0], 1, "x", 2),
             (2201, [3.0, -2.0], 1, "x", 2), (2300, [], 1, "x", 2), (2301, [], 1, "x", 2), (2400, [1.0], 1, "x", 2)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = ball_tree.top_k(df, F.col("vec_id") % 100 == 0, shard=shard, block=block).collect()
    once = [r for n, r in enumerate(rows) if r not in rows[:n] or r[0] != 1200]
    want = {t for t in brute_top(once) if t[0] == 1200} | {t for t in brute_top(rows) if t[0] != 1200}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert ball_tree.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [3e9, 1.0], 1, "x", 2), (1, [3e9, 2.0], 1, "x", 2), (2, [3e9, 1.5], 1, "x", 2), (3, [-3e12, 1.0], 1, "x", 2)]
    df = spark.createDataFrame(rows, VECTORS)
    got = [(r.vec_id, r.score) for r in ball_tree.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    whole = {i: [math.floor(1024 * float(np.float32(x))) for x in e] for i, e, *_ in rows}
    exact = {i: sum(a * b for a, b in zip(whole[0], whole[i])) for i in (1, 2, 3)}
    limit = 2**63 - 1
    assert got == sorted(((i, max(-limit - 1, min(limit, s))) for i, s in exact.items()), key=lambda x: (-x[1], x[0]))


def test_branch_and_bound_leaves_parts_out():
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(20, 8)) * 2000
    points = np.floor(np.repeat(centres, 200, axis=0) + rnd.normal(size=(4000, 8)) * 20)
    queries = points[:20]
    search = ball_tree.Search(np.arange(4000), points, np.arange(20), queries, np.full(20, -np.inf), 10)
    search.run()
    scores = queries @ points.T
    np.fill_diagonal(scores, -np.inf)
    for row, q in zip(scores, range(20)):
        order = sorted(range(4000), key=lambda i: (-row[i], i))[:10]
        assert search.best_ids[q].tolist() == order
    leaves = sum(left < 0 for _, _, left, _ in search.tree.nodes)
    assert search.visited < 20 * leaves / 4


# --- language model -------------------------------------------------------------------
def test_base_scores_are_exact(spark):
    rows = documents()
    df = frame(spark, rows).repartition(4)
    held = [zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, *_ in rows]
    counts = Counter()
    for (i, t, *_), out in zip(rows, held):
        if not out:
            counts.update(words(t) + [None])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for (i, t, *_), out in zip(rows, held):
        tokens = words(t) + [None]
        score = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        want.append((i, out, len(tokens), sum(counts[w] > 0 for w in tokens), total, round(score, 6)))
    got = [(*r[:5], round(r.base_score, 6)) for r in log_bloom.scores(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert log_bloom.scores(df.limit(0)).collect() == []


def build(counts):
    """The filter of a small table (n, gram, times) in one place."""
    rows = counts.select("gram", "times").toPandas()
    return log_bloom.LogBloom(rows["gram"].to_numpy(np.int64).view(np.uint64), rows["times"].to_numpy(np.int64))


def test_filter_answers_counts(spark):
    rnd = random.Random(6)
    rows = [(1 + i % 2, rnd.getrandbits(63), rnd.choice([1, 2, 3, 9, 70, 5000])) for i in range(6000)]
    bloom = build(spark.createDataFrame(rows, "n int, gram long, times long"))
    grams = np.array([g for _, g, _ in rows], np.uint64)
    level = np.floor(np.log2([t for *_, t in rows])).astype(int) + 1
    found = bloom.levels(grams)
    assert (found >= level).all() and (found == level).mean() > 0.97  # an answer can only be too high
    strangers = np.array([rnd.getrandbits(63) for _ in range(20_000)], np.uint64)
    assert (bloom.levels(strangers) > 0).mean() < 0.03


def test_filter_grows_with_its_items(spark):
    """Every count level keeps its n-grams however many there are, pairs seen once too."""
    n = 1_500_000
    rows = spark.range(n).selectExpr("2 AS n", "xxhash64(id) AS gram", "IF(id % 3 = 0, 1L, 6L) AS times")
    bloom = build(rows)
    assert len(bloom.bits) * 8 >= 10 * (n // 3 + 3 * (n - n // 3))
    some = rows.limit(5000).collect()
    found = bloom.levels(np.array([r.gram for r in some], np.int64).view(np.uint64))
    level = np.array([r.times.bit_length() for r in some])
    assert (found >= level).all() and (found == level).mean() > 0.97
    once = spark.createDataFrame([("only once here",)], "text string")
    assert log_bloom.count_ngrams(once).filter("n = 2").count() == 4


def test_scores_do_not_depend_on_parts_and_chunks(spark, monkeypatch):
    df = frame(spark, documents()).repartition(3)
    got = []
    for parts, chunk in ((1, 4_000_000), (64, 2000), (4096, 2000)):
        monkeypatch.setattr(log_bloom, "PARTS", parts)
        monkeypatch.setattr(log_bloom, "CHUNK", chunk)
        rows = log_bloom.scores(df).collect()
        got.append(sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.score, 6)) for r in rows), key=str))
    assert got[0] == got[1] == got[2]


def test_parts_grow_with_the_corpus(spark, monkeypatch):
    """Beyond BUCKETS parts a bucket is a part: a part holds the n-grams of a bounded number of training tokens."""
    df = frame(spark, documents()).repartition(3)
    plain = {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in log_bloom.scores(df).collect()}
    monkeypatch.setattr(log_bloom, "BUCKETS", 64)
    monkeypatch.setattr(log_bloom, "PARTS", 1)
    monkeypatch.setattr(log_bloom, "PART_TOKENS", 40)
    assert {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in log_bloom.scores(df).collect()} == plain
    total = log_bloom.scores(df).first().train_tokens
    assert total // 40 > 64  # more parts than there were buckets


def test_scores_follow_the_model(spark):
    """The score is the smoothed sum over the filter's own answers, and held-out text scores above the base."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in log_bloom.scores(docs).collect()}
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    train = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 10 != 0).select("text")
    counts = log_bloom.count_ngrams(train)
    bloom = build(counts)
    total, distinct = counts.filter("n = 1").agg(F.sum("times"), F.count("*")).first()
    import pyarrow as pa

    for r in docs.limit(20).collect():
        flat, first = log_bloom.tokens(pa.array([r.text]))
        two, value, before = log_bloom.pairs(flat, first), 0.0, log_bloom.END
        for w, pair in zip(flat, two):
            c, cw, cp = (float(bloom.counts(np.array([x], np.uint64))[0]) for x in (w, before, pair))
            value += math.log10((min(cp, c, cw) + log_bloom.STRENGTH * (c + 0.1) / (total + 0.1 * (distinct + 1)))
                                / (cw + log_bloom.STRENGTH))
            before = w
        assert abs(value - got[r.doc_id].score) < 1e-6 * abs(value)


# --- mixing ---------------------------------------------------------------------------
def brute_mixture(rows, targets, budget, sweeps):
    cells = Counter()
    for i, t, lang, source in rows:
        n = len(words(t))
        body = t or ""
        topic = ("other" if 20 * sum(c in "|$%&#*!<>{}=" for c in body) > len(body) else
                 "short" if n < 100 else "article" if n < 800 else "long")
        key = tuple(v if v in targets[d] else "other" for d, v in (("source", source), ("lang", lang), ("topic", topic)))
        cells[key] += n
    cells = {c: n for c, n in cells.items() if n}
    total = sum(cells.values())
    w = {c: n / total for c, n in cells.items()}
    for _ in range(sweeps):
        for d, name in enumerate(("source", "lang", "topic")):
            present = {c[d] for c in cells}
            share = {v: targets[name].get(v, 0) / sum(targets[name].get(p, 0) for p in present) for v in present}
            held = defaultdict(float)
            for c, x in w.items():
                held[c[d]] += x
            w = {c: x * share[c[d]] / held[c[d]] if held[c[d]] else 0.0 for c, x in w.items()}
    p, left, open_ = {}, budget * total, set(c for c in cells if w[c] > 0)
    while open_:
        scale = left / sum(w[c] for c in open_)
        out = {c for c in open_ if scale * w[c] >= cells[c]}
        if not out:
            p.update({c: max(0.0, scale * w[c] / cells[c]) for c in open_})
            break
        first = min(out, key=lambda c: cells[c] / w[c])
        p[first] = 1.0
        left -= cells[first]
        open_.remove(first)
    return cells, w, p


TARGETS = {"source": {"src0": 0.5, "src1": 0.2, "gone": 0.1, "other": 0.2}, "lang": {"en": 0.8, "other": 0.2},
           "topic": {"short": 0.3, "article": 0.5, "other": 0.2}}


def test_raking_meets_every_margin_and_equals_brute_force(spark):
    rnd = random.Random(8)
    rows = documents() + [  # every cell has some text
        (1000 + k, prose(rnd, n) + " end" * rnd.randrange(9), lang, source, 1, "d", 1, 2, "k", 3, 4)
        for k, (n, lang, source) in enumerate((n, lang, source) for n in (20, 150, 900) for lang in ("en", "xx")
                                              for source in ("src0", "src1", "src2"))]
    rows += [(1100 + k, "| " * 30, lang, source, 1, "d", 1, 2, "k", 3, 4) for k, (lang, source) in enumerate(
        (lang, source) for lang in ("en", None) for source in ("src0", "src1", None))]
    df = frame(spark, rows)
    got = mixing.mixture(df, TARGETS, budget=0.5, sweeps=40).collect()
    cells, w, p = brute_mixture([r[:4] for r in rows], TARGETS, 0.5, 40)
    assert len(got) == len(rows)
    for r in got:
        key = (r.source, r.lang, r.topic)
        assert abs(r.probability - p.get(key, 0.0)) < 1e-6
        u = int(hashlib.md5(f"{mixing.SEED}:{'' if r._doc.doc_id is None else r._doc.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        assert r.sampled == (u < r.probability)
    tagged = mixing.tagged(df, TARGETS, "text", None).groupBy(*mixing.DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    raked = mixing.calibrate(tagged, TARGETS, 0.5, 40).collect()
    for d in mixing.DIMENSIONS:  # `gone` has no text, so the others share its part
        present = {r[d] for r in raked}
        for v in present:
            share = sum(r.weight for r in raked if r[d] == v)
            assert abs(share - TARGETS[d].get(v, 0) / sum(TARGETS[d].get(x, 0) for x in present)) < 1e-3
    assert abs(sum(r.probability * r.tokens for r in raked) - 0.5 * sum(r.tokens for r in raked)) < 1e-6 * sum(r.tokens for r in raked)
    assert all(0 <= r.probability <= 1 for r in raked)


def test_mixture_needs_no_special_rows(spark):
    df = frame(spark, documents())
    kept = mixing.sampled(df)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()
    assert mixing.sampled(df.limit(0)).collect() == []
    assert mixing.sampled(df.filter("doc_id IN (203, 204, 205)")).collect() == []  # no words, no weight
    assert mixing.sampled(df, budget=1.0, targets={d: {"other": 1.0} for d in mixing.DIMENSIONS}).count() == df.count()
    with pytest.raises(ValueError):
        mixing.calibrate(df, {d: {str(i): 0.1 for i in range(40)} for d in mixing.DIMENSIONS}, 0.5, 1)
    plan = mixing.mixture(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan


# --- quality --------------------------------------------------------------------------
def test_labels_come_from_agreement():
    """Planted labellers of known accuracy: estimation finds them without seeing a label."""
    rnd = np.random.default_rng(2)
    truth = rnd.random(20_000) < 0.8
    right = [0.95, 0.9, 0.9, 0.85, 0.85, 0.8, 0.8, 0.9, 0.95]
    votes = np.stack([np.where(rnd.random(20_000) < 0.3, weak_labels.NONE,
                               np.where(rnd.random(20_000) < a, truth, ~truth)) for a in right], axis=1)
    codes = votes @ (3 ** np.arange(9))
    patterns, at, counts = np.unique(codes, return_inverse=True, return_counts=True)
    prior, tables, posterior = weak_labels.estimate(patterns, counts)
    assert abs(prior - 0.8) < 0.02
    assert max(abs(tables[1, k, 1] - a) for k, a in enumerate(right)) < 0.03
    assert ((posterior[at] > 0.5) == truth).mean() > 0.97


def test_classifier_agrees_with_labels_it_never_saw(spark):
    """Labels are looked at here only; training uses none of them."""
    d = "/root/testdata/sf0.1"
    rows = weak_labels.quality(spark.read.parquet(f"{d}/documents.parquet")).select("_doc.doc_id", "kept")
    seen = spark.read.parquet(f"{d}/labels.parquet").join(rows, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in seen}
    assert n.get((1, False), 0) <= 0.002 * n[(1, True)]  # clean documents stay
    assert n.get((0, True), 0) <= 0.03 * n[(0, False)]  # junk goes


def test_rows_without_ids_are_learned_from_and_scored_apart(spark):
    """80,000 rows without an id: the sample is drawn from their texts, and a row that repeats counts once in it."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").filter("length(text) < 3000").limit(400)
    rows = real.crossJoin(spark.range(200)).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", "text", F.col("id") % 100).alias("text"))
    assert rows.count() == 80_000
    spread = weak_labels.quality(rows).agg(F.countDistinct("score"), F.count_if("kept"), F.count("*")).first()
    assert spread[0] > 200 and 0 < spread[1] < spread[2] == 80_000


def test_only_the_sample_meets_in_one_task(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("r"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("t"))
    every = rows.unionByName(rows).unionByName(spark.range(9000).select(F.lit(1 << 40).alias("r"), F.lit("one row").alias("t")))
    found = weak_labels.sampled_features(every, {k: 0.5 for k in range(3**9)}, 500, 19_000)
    n = found.count()
    assert 60 < n < 300 and found.select("r").distinct().count() == n
    # the scan and the features stand below the exchange that brings the sample into one task
    plan = found.repartition(1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Repartition 1") < plan.index("MapInArrow") < plan.index("Filter") and "Repartition" not in plan[plan.index("MapInArrow"):]


def test_quality_keeps_rows_and_columns(spark):
    rows = documents()
    df = frame(spark, rows)
    got = weak_labels.quality(df).collect()
    assert len(got) == len(rows) and sorted((tuple(r._doc) for r in got), key=str) == sorted(rows, key=str)
    for r in got:
        empty = not words(r._doc.text)
        assert (r.score == 0 and not r.kept) if empty else 0 < r.score < 1
    scores = defaultdict(set)
    for r in got:
        scores[r._doc.text].add(r.score)
    assert all(len(s) == 1 for s in scores.values())
    assert weak_labels.good_documents(df).columns == df.columns
    assert weak_labels.good_documents(df.limit(0)).collect() == []
    assert weak_labels.good_documents(df.filter("text = ''")).collect() == []
    assert weak_labels.quality(df, sample=5).count() == len(rows)


def test_mixture_sql_is_plain_duckdb():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    assert con.execute(mixture_sql()).fetchall() == []


def test_raking_meets_the_marginals(spark):
    """What is left to the targets after the last sweep, on given documents with all targets present."""
    targets = {"source": mixing.SOURCES, "lang": mixing.LANGS, "topic": mixing.TOPICS}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cells = mixing.tagged(docs, targets, "text", None).groupBy(*mixing.DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    rows = mixing.calibrate(cells, targets, mixing.BUDGET, mixing.SWEEPS).collect()
    for d in mixing.DIMENSIONS:
        held = defaultdict(float)
        for r in rows:
            held[r[d]] += r.weight
        present = sum(targets[d].get(v, 0.0) for v in held)
        left = max(abs(w - targets[d].get(v, 0.0) / present) for v, w in held.items())
        print(f"residual of {d}: {left:.2e}")
        assert left < 1e-3
