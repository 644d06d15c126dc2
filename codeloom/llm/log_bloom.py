"""Language-model scoring with a log-frequency Bloom filter.

Words and word pairs of the training texts are counted over the whole corpus, folded in tasks before the shuffle.
The filter holds, for an n-gram of quantised count q = 1 + floor(log2(count)), the items (n-gram, 1) to (n-gram, q). A
lookup probes for 1, 2, ... until the first miss, so a wrong answer can only be too high. N-grams lie in buckets by
their hash, and the bits of a bucket grow with its items, BITS_PER_ITEM each: every n-gram of every count is in the
filter, pairs seen once too. The filter grows with the corpus, so it is never gathered or sent whole. Texts are dealt
to chunks; the distinct n-grams of a chunk go, with their counts there, to the part that holds their buckets. A part is
built from all it was sent, answers for it, and the levels come back to the chunk. Parts, chunks and, from BUCKETS
parts on, buckets get more, not larger, as the corpus grows.

A text's score sums log10 of (c(u, w) + STRENGTH * p(w)) / (c(u) + STRENGTH), with p(w) the add-0.1 share of w, all
counts as the filter gives them; the context of the first word is the end of a text.

The base score uses exact counts, which the parts give for words besides the levels; no word list is broadcast.

Defined cases: null and empty texts are one end token; texts without an id are held out; rows that repeat are
scored each; without training texts all counts are 0; an empty table gives an empty one; other columns are not read.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.words import mix, ngram_hashes, pieces, word_hashes
from codeloom.session import written

END = np.uint64(0x5DEECE66D1234567)
ALPHA = 0.1
#: at least so many buckets; a part holds one or more
BUCKETS = 4096
#: so many training tokens a part, but at least PARTS parts; a power of two of them
PART_TOKENS = 1_000_000
PARTS = 64
#: bytes of text whose n-grams are asked for together
CHUNK = 4_000_000
BITS_PER_ITEM = 10
PROBES = 5
STRENGTH = 1000.0
#: n-grams that a task gathers before it folds them
FOLD = 2_000_000
#: n-grams looked up at a time
SLICE = 1 << 18
_COUNTS = "n int, gram long, times long"
_TEXTS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
#: n-grams of a chunk that lie in one part, and how often they are there in training texts
_ASKED = "chunk long, n int, part int, grams binary, times binary"
#: the levels, and the exact counts of words
_ANSWERS = "chunk long, n int, part int, levels binary, times binary"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by END, and where each text begins."""
    words, first = word_hashes(texts)
    return np.insert(words, first[1:], END), first + np.arange(len(first))


def pairs(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; END stands before the first."""
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[first[:-1]] = END
    return ngram_hashes(np.stack([before, flat], axis=1).reshape(-1), 2)[::2]


def _folded(n: int, held: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
    grams, at = np.unique(np.concatenate(held), return_inverse=True)
    sums = np.bincount(at, np.concatenate(times), len(grams)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), n, np.int32)), pa.array(grams.view(np.int64)),
                                       pa.array(sums)], names=["n", "gram", "times"])


def _counted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (n, gram, times) of n-grams of at most `most` words, folded over many texts."""
    held: dict[int, tuple[list, list]] = {n: ([], []) for n in range(1, most + 1)}
    size = 0

    def release() -> Iterator[pa.RecordBatch]:
        for n, (grams, times) in held.items():
            if grams:
                whole = _folded(n, grams, times)
                for k in range(0, whole.num_rows, 200_000):
                    yield whole.slice(k, 200_000)
                grams.clear()
                times.clear()

    for batch in pieces(batches, 0):
        flat, first = tokens(batch.column(0))
        for n in held:
            grams = flat if n == 1 else pairs(flat, first)
            own, times = np.unique(grams, return_counts=True)
            held[n][0].append(own)
            held[n][1].append(times)
            size += len(own)
        if size > FOLD:
            yield from release()
            size = 0
    yield from release()


def _buckets(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(grams) % np.uint64(buckets)).astype(np.int64)


class LogBloom:
    """The filter of n-grams with their counts, buckets side by side; `levels` answers for many n-grams at once."""

    def __init__(self, grams: np.ndarray, times: np.ndarray, buckets: int = BUCKETS):
        self.buckets = buckets
        level = np.frexp(times.astype(np.float64))[1].astype(np.int64)  # 1 + floor(log2), 0 for none
        items = np.bincount(_buckets(grams, buckets), level, buckets).astype(np.int64)
        self.sizes = np.maximum(64, items * BITS_PER_ITEM) * (items > 0)
        self.starts = np.cumsum(self.sizes) - self.sizes
        bits = np.zeros(int(self.sizes.sum()), bool)
        for a in range(0, len(grams), SLICE):
            own, held = grams[a:a + SLICE], level[a:a + SLICE]
            for k in range(1, int(held.max()) + 1):
                bits[self._places(own[held >= k], k)] = True
        self.bits = np.packbits(bits)

    def _places(self, grams: np.ndarray, level: int) -> np.ndarray:
        """PROBES bits of each n-gram for one level."""
        bucket = _buckets(grams, self.buckets)
        item = mix(grams + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
        step = mix(item) | np.uint64(1)
        turns = (item[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) >> np.uint64(32)
        size = self.sizes[bucket].astype(np.uint64)
        if self.sizes.max(initial=0) < 1 << 32:
            at = (turns * size[:, None]) >> np.uint64(32)
        else:
            at = mix(turns) % size[:, None]
        return self.starts[bucket][:, None] + at.astype(np.int64)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        found = np.zeros(len(grams), np.int64)
        for a in range(0, len(grams), SLICE):
            own = grams[a:a + SLICE]
            open_ = np.flatnonzero(self.sizes[_buckets(own, self.buckets)])
            for level in range(1, 65):  # up to the first miss, whatever levels the other n-grams have
                bit = self._places(own[open_], level)
                held = (self.bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
                open_ = open_[held.all(axis=1)]
                if not len(open_):
                    break
                found[a + open_] = level
        return found

    def counts(self, grams: np.ndarray) -> np.ndarray:
        own, at = np.unique(grams, return_inverse=True)
        return _middle(self.levels(own))[at]


def _middle(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level; 0 for a miss."""
    return np.where(level > 0, 1.5 * 2.0 ** (level.astype(np.int64) - 1) - 0.5, 0.0)


def _by_part(grams: np.ndarray, parts: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the n-grams by part, the parts they have, and where each begins in it."""
    part = _buckets(grams, buckets) % parts
    order = np.argsort(part, kind="stable")
    return order, *np.unique(part[order], return_index=True)


def _grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Tokens of a chunk's texts and where each text begins; (distinct n-grams, where they stand) for n = 1, 2."""
    flat, first = tokens(table["text"])
    found = [np.unique(grams, return_inverse=True) for grams in (flat, pairs(flat, first))]
    return flat, first, np.diff(first), found


def _asked(table: pa.Table, parts: int, buckets: int) -> pa.Table:
    """The n-grams of a chunk for the parts."""
    _, _, n, found = _grams(table)
    trained = np.repeat(~table["held_out"].to_numpy(), n).astype(np.float64)
    columns: list[list] = [[], [], [], []]
    for k, (grams, at) in enumerate(found, 1):
        times = np.bincount(at, trained, len(grams)).astype(np.int64)
        times = times.astype(np.min_scalar_type(int(times.max(initial=0))))
        order, own, first = _by_part(grams, parts, buckets)
        columns[0] += [k] * len(own)
        columns[1] += own.tolist()
        columns[2] += [x.tobytes() for x in np.split(grams[order], first[1:])]
        columns[3] += [x.tobytes() for x in np.split(times[order], first[1:])]
    kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary()
    return pa.table([pa.array([table["chunk"][0].as_py()] * len(columns[0]), pa.int64()),
                     *[pa.array(c, kind) for c, kind in zip(columns, kinds)]], names=["chunk", "n", "part", "grams", "times"])


def _answered(table: pa.Table, buckets: int) -> pa.Table:
    """Levels for all that was asked of a part, from a filter of all that its n-grams count."""
    asked = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
    times = [np.frombuffer(x, f"u{len(x) // len(g)}") for x, g in zip(table["times"].to_pylist(), asked)]
    grams, at = np.unique(np.concatenate(asked), return_inverse=True)
    times = np.bincount(at, np.concatenate(times), len(grams)).astype(np.int64)
    bloom = LogBloom(grams, times, buckets)
    ends = np.cumsum([len(g) for g in asked])[:-1]
    found = np.split(bloom.levels(grams).astype(np.uint8)[at], ends)
    exact = [x.tobytes() if n == 1 else b"" for n, x in zip(table["n"].to_pylist(), np.split(times[at], ends))]
    return pa.table([table["chunk"], table["n"], table["part"], pa.array([x.tobytes() for x in found], pa.binary()),
                     pa.array(exact, pa.binary())], names=["chunk", "n", "part", "levels", "times"])


def _scored(table: pa.Table, answers: pa.Table, total: int, distinct: int, parts: int, buckets: int) -> pa.Table:
    """The texts of a chunk with their scores."""
    base = total + ALPHA * (distinct + 1)
    flat, first, n, found = _grams(table)
    starts, ends = first[:-1], first[1:]
    told = sorted(zip(*[answers[c].to_pylist() for c in ("n", "part", "levels", "times")]))
    own, at = found[0]
    exact = np.empty(len(own), np.int64)
    exact[_by_part(own, parts, buckets)[0]] = np.frombuffer(b"".join(x for *_, x in told), np.int64)
    part, known = np.log10((exact + ALPHA) / base)[at], (exact > 0).astype(np.int64)[at]
    counts = []
    for k, (grams, where) in enumerate(found, 1):  # answers come by part, n-grams in order within
        level = np.empty(len(grams), np.uint8)
        level[_by_part(grams, parts, buckets)[0]] = np.frombuffer(b"".join(x for m, _, x, _ in told if m == k), np.uint8)
        counts.append(_middle(level)[where])
    times, together = counts
    before = np.empty_like(times)
    before[1:] = times[:-1]
    before[starts] = times[ends - 1]  # every text has its end as a token
    together = np.minimum(together, np.minimum(times, before))
    share = (times + ALPHA) / base
    score = np.add.reduceat(np.log10((together + STRENGTH * share) / (before + STRENGTH)), starts)
    return pa.table([
        table["doc_id"], table["held_out"], pa.array(n), pa.array(np.add.reduceat(known, starts)),
        pa.array(np.add.reduceat(part, starts)), pa.array(score)], names=[c.split()[0] for c in _TEXTS.split(", ")])


def count_ngrams(texts: DataFrame, most: int = 2) -> DataFrame:
    """(n, gram, times) of all words, and of all pairs if `most` is 2, of a one-column table of texts."""
    rows = texts.mapInArrow(partial(_counted, most=most), _COUNTS)
    return written(rows.groupBy("n", "gram").agg(F.sum("times").alias("times")))


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       (F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))) % 10 == 0).alias("held_out"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    words = count_ngrams(rows.filter("NOT held_out").select("text"), 1).select("gram", "times")
    total, distinct = words.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*")).first()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(PARTS, 1 << (total // PART_TOKENS).bit_length())
    buckets = max(BUCKETS, parts)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // CHUNK + 1))
    texts = rows.select(chunk.alias("chunk"), "*").repartition("chunk")  # both readers share this exchange
    asked = texts.groupBy("chunk").applyInArrow(lambda rows: _asked(rows, parts, buckets), _ASKED)
    answers = asked.groupBy("part").applyInArrow(lambda rows: _answered(rows, buckets), _ANSWERS)
    done = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda rows, levels: _scored(rows, levels, total, distinct, parts, buckets), _TEXTS)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                       "base_score", "score")
