"""Periodic runs of words, found in tiles of one period octave each and stitched by document and period.

A run is a stretch of words with smallest period q, at least max(6, 4q) long, that no neighbouring word extends.
With m[i] = (word i equals word i + q), it is a longest interval of true m, of length at least max(6, 4q) - q, hence
at least 3B for a period in the octave [B, 2B). Of such an interval:

* Boundaries lie B words apart. The first one inside it sees at most B matches before it and more than 2B after it.
* A boundary is an anchor when the 2B words from it come again p in [B, 2B) words later. Window hashes find all
  anchors of a batch in one pass per octave; they only leave out, what they let through is settled by words.
* The words around the anchors are cut into tiles of 8B words, overlapping by 6B (at least 1,024 words, so that small
  periods don't make many rows). Tiles are rows of their own: they are dealt out anew and solved independently, so one
  very long document keeps many tasks busy, and equal tiles of copies are solved once.
* In a tile, two Z-functions per anchor give, for all periods of the octave at once, how far the words match onwards
  (up to 3B) and backwards (up to B). Each match is a fragment of the interval; neighbouring ones overlap or touch.
* Fragments are shuffled by document and period and stitched to the whole interval.

An interval with a multiple of the smallest period is the same stretch of words, so equal stretches keep the least.

Memory: a task holds one piece of about 4 MB of texts (or one longer text) and what its tiles need. Documents without
anchors, nearly all in natural text, are never shuffled. The texts that have some are written once to the shared
folder, so a lost executor costs only its own tasks.

Defined cases: null and empty texts have no words and no runs; words are compared as they are, by bytes; results
depend on the text alone, so repeated rows and null ids give their own rows; an empty table gives an empty one; other
columns are not read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.llm.words import buffers, mix, pieces
from codeloom.session import written

# fixed values: a run has at least this many words, and this many periods
LEAST_WORDS, LEAST_PERIODS = 6, 4
TILE_BLOCKS, TILE_WORDS = 8, 1024
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
RUN = "struct<start:bigint,length:bigint,period:bigint>"


# --- words and anchors ---------------------------------------------------------------
def split_texts(texts: pa.Array) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, all words as numbers that are equal where words are, and where each text's words begin."""
    data, offsets = buffers(texts)
    flat = data.tobytes()
    # bytes.split() cuts at [\x20\x09-\x0D]
    words = [flat[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    first = np.cumsum([0, *map(len, words)])
    every = pa.array([w for one in words for w in one], pa.binary())
    return words, every.dictionary_encode().indices.to_numpy().astype(np.int64), first


def anchors(numbers: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each octave (B, positions of its anchors), over the words of several texts in one array."""
    longest = int(np.diff(first).max(initial=0))
    window = mix(numbers.astype(np.uint64) + np.uint64(1))
    block = 1
    while LEAST_PERIODS * block <= longest:
        window = mix(window[:-block] * _FACTOR + window[block:])  # now of 2 * block words from each place on
        rows = -(-len(window) // block)
        # what is missing in the last row must not equal the boundary it is compared with
        padded = np.full(rows * block, ~window[max(rows - 2, 0) * block], dtype=np.uint64)
        padded[:len(window)] = window
        grid = padded.reshape(rows, block)
        at = np.flatnonzero((grid[1:] == grid[:-1, :1]).any(axis=1)) * block
        yield block, at[np.searchsorted(first, at, "right") == np.searchsorted(first, at + 3 * block - 1, "right")]
        block *= 2


def _with_anchors(numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, whether it has an anchor."""
    found = np.zeros(len(first) - 1, dtype=bool)
    for _, at in anchors(numbers, first):
        found[np.searchsorted(first, at, "right") - 1] = True
    return found


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> rows whose text has an anchor: doc_id, text_key, text."""
    for batch in pieces(batches, 1):
        words, numbers, first = split_texts(batch.column(1))
        some = pa.array(_with_anchors(numbers, first))
        ids, texts = batch.column(0).filter(some), batch.column(1).filter(some)
        keys = [hashlib.blake2b(t.as_buffer(), digest_size=16).hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.string()), texts], names=["doc_id", "text_key", "text"])


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> rows whose text has no anchor, their words joined by one space: doc_id, collapsed."""
    for batch in pieces(batches, 1):
        words, numbers, first = split_texts(batch.column(1))
        none = ~_with_anchors(numbers, first)
        shown = [b" ".join(words[k]) for k in np.flatnonzero(none).tolist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(none)), _strings(shown)], names=["doc_id", "collapsed"])


def _strings(values: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(values), pa.py_buffer(ends), pa.py_buffer(b"".join(values))).cast(pa.string())


# --- tiles -----------------------------------------------------------------------------
def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, text) -> text_key, block, at, anchors (inside the tile), words (as numbers)."""
    for batch in pieces(batches, 1, 1_000_000):
        _, numbers, first = split_texts(batch.column(1))
        keys = batch.column(0).to_pylist()
        rows = []
        for block, at in anchors(numbers, first):
            owner = np.searchsorted(first, at, "right") - 1
            tile = (at - first[owner]) // max(TILE_WORDS, TILE_BLOCKS * block)
            cuts = np.flatnonzero((np.diff(owner) != 0) | (np.diff(tile) != 0)) + 1
            for part in np.split(np.arange(len(at)), cuts) if len(at) else []:
                k = owner[part[0]]
                lo = max(int(at[part[0]]) - block, int(first[k]))
                hi = min(int(at[part[-1]]) + 5 * block, int(first[k + 1]))
                # numbers by first appearance inside the tile, so that equal tiles of copies are equal rows
                _, seen, inverse = np.unique(numbers[lo:hi], return_index=True, return_inverse=True)
                own = np.argsort(np.argsort(seen))[inverse].astype(np.int32)
                rows.append((keys[k], block, lo - int(first[k]), (at[part] - lo).astype(np.int32), own))
                if len(rows) == 2000:
                    yield _tile_batch(rows)
                    rows = []
        yield _tile_batch(rows)


def _tile_batch(rows: list[tuple]) -> pa.RecordBatch:
    keys, blocks, at, places, words = zip(*rows) if rows else ([], [], [], [], [])
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array(blocks, pa.int64()), pa.array(at, pa.int64()),
         pa.array(places, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int32()))],
        names=["text_key", "block", "at", "anchors", "words"])


def z_function(s: list[int]) -> list[int]:
    """For each place of s, how many items from there equal those from the start."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def tile_fragments(words: list[int], places: list[int], block: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the matching intervals around the anchors, inside the tile; merged where they meet."""
    found: dict[int, list[list[int]]] = {}
    for c in places:
        ahead = z_function(words[c:c + 5 * block])
        periods = [p for p in range(block, min(2 * block, len(ahead))) if ahead[p] >= 2 * block]
        if not periods:
            continue
        low = max(0, c - block)
        behind = words[low:c][::-1]
        # backwards from the anchor, against backwards from a period later
        z = z_function([*behind, -1, *words[low:c + 2 * block - 1][::-1]])
        tail = len(words[low:c + 2 * block - 1])
        for p in periods:
            back = min(z[len(behind) + 1 + tail - (c + p - low)], block) if behind else 0
            start, end = c - back, c + min(ahead[p], 3 * block)
            held = found.setdefault(p, [])
            if held and start <= held[-1][1]:
                held[-1][1] = max(end, held[-1][1])
            else:
                held.append([start, end])
    return [(p, start, end) for p, held in found.items() for start, end in held]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, periods, starts, ends = [], [], [], []
        for row in batch.to_pylist():
            for p, start, end in tile_fragments(row["words"], row["anchors"], row["block"]):
                keys.append(row["text_key"])
                periods.append(p)
                starts.append(row["at"] + start)
                ends.append(row["at"] + end)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array(c, pa.int64()) for c in (periods, starts, ends)]],
                                         names=["text_key", "period", "start", "end"])


# --- the operator ------------------------------------------------------------------------
def stitched(fragments: DataFrame) -> DataFrame:
    """Fragments (text_key, period, start, end) that overlap or touch become one interval."""
    each = ["text_key", "period"]
    inside = Window.partitionBy(*each).orderBy("start", "end")
    reach = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= reach, 0).otherwise(1)
    joined = fragments.distinct().withColumn("_fresh", fresh).withColumn("_part", F.sum("_fresh").over(inside))
    return joined.groupBy(*each, "_part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_part")


def text_runs(marked: DataFrame) -> DataFrame:
    """(text_key, text) -> text_key, start, length, period: every run of every text, once per text."""
    tiles = marked.select("text_key", "text").mapInArrow(
        _tiles, "text_key string, block long, at long, anchors array<int>, words array<int>").distinct()
    fragments = tiles.mapInArrow(_solved, "text_key string, period long, start long, end long")
    length = F.col("end") - F.col("start") + F.col("period")
    whole = stitched(fragments).withColumn("length", length).filter(
        F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period")))
    return whole.groupBy("text_key", "start", "length").agg(F.min("period").alias("period"))


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, runs) -> doc_id, runs, collapsed."""
    for batch in pieces(batches, 1):
        shown = []
        data, offsets = buffers(batch.column(1))
        for runs, a, b in zip(batch.column(2).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            words = data[a:b].tobytes().split()
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            for run in runs or []:
                edge[run["start"] + run["period"]] += 1
                edge[run["start"] + run["length"]] -= 1
            kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
            shown.append(b" ".join([words[k] for k in kept]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _strings(shown)], names=["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length, period; by start, then period), collapsed (the text without repetitions).

    A word is left out of `collapsed` if a run holds it after that run's first period; the others are joined by one space.
    """
    keyed = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    marked = written(keyed.mapInArrow(_marked, "doc_id long, text_key string, text string"))
    every = F.array_sort(F.collect_list(F.struct("start", "period", "length")))
    held = text_runs(marked).groupBy("text_key").agg(
        F.transform(every, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    told = marked.join(held, "text_key", "left").select(
        "doc_id", "text", F.coalesce("runs", F.array().cast(f"array<{RUN}>")).alias("runs"))
    rows = told.mapInArrow(_collapsed, f"doc_id long, runs array<{RUN}>, collapsed string")
    rest = keyed.mapInArrow(_plain, "doc_id long, collapsed string").select(
        "doc_id", F.array().cast(f"array<{RUN}>").alias("runs"), "collapsed")
    return rows.unionByName(rest)


def greatest_run(runs: Column) -> Column:
    """The longest run; of equal ones that with the least start, then period. Null without runs."""
    best = F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.get(best, F.lit(0))


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, where about a tenth of the texts repeat from some word on.

    With h = crc32 of the decimal id and g = floor(h / 10): where h % 10 = 0, each word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Texts without an id stay as they are.
    """
    key, shown = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")
    h = F.crc32(key.cast("string"))
    words = F.filter(F.split(shown, "[ \\t-\\r]+"), lambda w: w != "")
    rows = docs.select(key.alias("doc_id"), shown.alias("text"), F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.nullif(F.size("w"), F.lit(0))).withColumn("a", F.col("g") % F.col("n"))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    dealt = F.transform("w", lambda _, i: F.get("w", place(i).cast("int")))
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(dealt, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the greatest run, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = greatest_run(F.col("runs"))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("best.n"), F.col("best.period")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
