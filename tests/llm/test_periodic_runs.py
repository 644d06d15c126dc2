"""Tile solver, stitching and the whole operator against a plain reading of the rules."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import period_tiles as P
from codeloom.llm.queries import QUERIES
from tests.llm.samples import documents, frame


def brute_runs(words):
    """(start, length, period) by every start and period; of equal stretches the least period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n_, q) for (s, n_), q in found.items())


def brute_planted(doc_id, words):
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_row(doc_id, words):
    runs = brute_runs(words)
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def odd_texts(seed=3):
    rnd = random.Random(seed)
    out = ["a " * 700, "a b " * 300, "x " * 5, "x " * 6, "ab ab ab ab", "a b a b a b a b", "a b a b a b a", "a a a b a a a b a a a b a a a b"]
    for _ in range(60):
        p, times, around = rnd.randrange(1, 90), rnd.randrange(2, 9), rnd.randrange(0, 50)
        unit = [f"w{rnd.randrange(rnd.choice([2, 4, 500]))}" for _ in range(p)]
        body = (unit * (times + 1))[:p * times + rnd.randrange(p)]
        noise = lambda: [f"n{rnd.randrange(9)}" for _ in range(around)]
        out.append(" ".join(noise() + body + noise()))
    for size in (40, 300, 2000):  # two letters: many short runs inside each other
        out.append(" ".join(rnd.choice("ab") for _ in range(size)))
    big = [f"v{rnd.randrange(3000)}" for _ in range(900)]
    out.append(" ".join([f"n{k}" for k in range(1500)] + big * 5 + ["end"] * 40))
    out.append(" ".join(f"u{k % 7}" for k in range(9000)))
    out.append(" ".join("zz" for _ in range(9)) + "\x0b" + "  " * 8)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_tiles_of_random_words_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        words = [rnd.choice("abc"[:rnd.choice([1, 2, 3])]) for _ in range(rnd.randrange(0, 70))]
        first = np.array([0, len(words)])
        numbers = np.array([ord(w) for w in words], dtype=np.int64)
        intervals = {}
        for block, at in P.anchors(numbers, first):
            for p, s, e in P.tile_fragments(numbers.tolist(), at.tolist(), block):
                if e - s + p >= max(6, 4 * p):
                    intervals[s, e - s + p] = min(p, intervals.get((s, e - s + p), p))
        assert sorted((s, n, q) for (s, n), q in intervals.items()) == brute_runs(words)


def test_z_function():
    for s in ([], [1], [1, 1, 1, 1], [1, 2, 1, 2, 1, 3, 1, 2, 1, 2, 1]):
        want = [0] + [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]
        assert P.z_function(s) == want[:len(s)]


def test_runs_equal_brute_force(spark):
    rows = [(k, t, "en", "s", 1, "d", 1, 2, "k", 3, 4) for k, t in enumerate(odd_texts(), 1000)]
    rows += [(None, "q " * 30, "en", "s", 1, "d", 1, 2, "k", 3, 4)] * 3 + [rows[0]] + documents()
    got = P.digests(P.periodic_runs(frame(spark, rows)))
    want = [brute_row(r[0], split(r[1])) for r in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[1] for w in want) > 100


def test_stitching_does_not_depend_on_how_tiles_fall(spark, monkeypatch):
    """Fragments of one interval from many tiles; tiles of eight words cut every run."""
    monkeypatch.setattr(P, "TILE_WORDS", 8)
    monkeypatch.setattr(P, "TILE_BLOCKS", 1)
    texts = odd_texts(5)
    batch = P.pa.RecordBatch.from_arrays([P.pa.array([str(k) for k in range(len(texts))]), P.pa.array(texts)], names=["text_key", "text"])
    tiles = P.pa.Table.from_batches(list(P._tiles(iter([batch]))))
    assert tiles.num_rows > 2000
    parts = P.pa.Table.from_batches(list(P._solved(iter(tiles.to_batches()))))
    rows = P.stitched(spark.createDataFrame(parts.to_pandas())).collect()
    for k, text in enumerate(texts):
        found = {}
        for r in rows:
            if r.text_key == str(k) and r.end - r.start + r.period >= max(6, 4 * r.period):
                found[r.start, r.end - r.start + r.period] = min(r.period, found.get((r.start, r.end - r.start + r.period), 1 << 40))
        assert sorted((s, n, q) for (s, n), q in found.items()) == brute_runs(split(text))


def test_runs_and_text_of_the_operator(spark):
    df = spark.createDataFrame([(1, "to be or not to be or not to be or not to be or not end"), (2, None)], "n long, runs string")
    got = {r.doc_id: r for r in P.periodic_runs(df, "n", "runs").collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 16, 4)] and got[1].collapsed == "to be or not end"
    assert got[2].runs == [] and got[2].collapsed == ""
    assert P.digests(P.periodic_runs(frame(spark, []))).collect() == []


def test_planted_texts(spark):
    rows = documents() + [(k, " ".join(f"w{i}" for i in range(k % 37)), "en", "s", 1, "d", 1, 2, "k", 3, 4) for k in range(5000, 5200)]
    got = P.planted(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, split(r.text)) for r in got), key=str) == sorted(((r[0], brute_planted(r[0], split(r[1]))) for r in rows), key=str)
    assert sum(brute_planted(r[0], split(r[1])) != split(r[1]) for r in rows) > 10


def test_query_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.length("text") < 6000)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = docs.select("doc_id", "text").collect()
    got = QUERIES["op12_periodic_runs"][0](spark, str(tmp_path)).collect()
    want = [brute_row(r.doc_id, brute_planted(r.doc_id, split(r.text))) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 5
