"""Quality classifier from weak labels.

Nine overlapping heuristic labellers vote good, bad or nothing on every document. Documents are counted by their
pattern of votes, at most 3**9 patterns whatever the corpus holds, and expectation-maximisation over these counts
estimates how often each labeller says what of good and of bad documents. The posterior of a pattern is the label
of its documents. A linear scorer over hashed features (words, word shapes, repeats, coarse ratios) learns these
labels on a bounded sample of about SAMPLE documents, fixed by a hash of their ids and texts, equal rows counted once,
and scores every document. Features are made where the documents are; only those of the sample meet in one task.

Defined cases: documents without words (null and empty texts) are rejected with score 0; a short text that no
labeller votes on has the prior as its label and is kept unless its features speak against it; rows that repeat an
id or a text are scored alike, and rows without ids like all others; an empty table gives an empty one; other columns are kept as they are.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from codeloom.llm.words import buffers, mix, pieces, word_hashes, word_spans
from codeloom.session import cut_lineage

GOOD, BAD, NONE = 1, 0, 2
LABELLERS = ("symbols", "capitals", "variety", "lines", "endings", "function words", "word length", "sentences", "runs")
#: documents the scorer learns from
SAMPLE = 12_000
BUCKETS = 1 << 15
EPOCHS = 12
BATCH = 256
RATE = 0.5
DECAY = 1e-6
ROUNDS = 200
#: a document goes when its score is below this
THRESHOLD = 0.5
FUNCTION_WORDS = (
    "the of and to a in is it that for on with as was are be this by at or an from not but have "
    "der die und das von zu mit den ist im ein eine nicht sich auf dem des für als auch "
    "de la le les et des du un une en que qui dans est pour au par sur pas avec il elle "
    "el los las y del se por con para su una lo al es no").split()

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_SMALL = np.zeros(256, dtype=bool)
_SMALL[97:123] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in "|$%&#*!<>{}=@^~_\\+/"]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".?!"]] = True
_KIND = np.select([_CAPITAL, _LETTER, (np.arange(256) >= 48) & (np.arange(256) < 58), _STOP], [1, 2, 3, 4], 5)


def _ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


class Facts:
    """Words, features and statistics of a batch of texts."""

    def __init__(self, texts: pa.Array):
        data, offsets = buffers(texts)
        self.hashes, self.first = word_hashes(texts)
        starts, ends = word_spans(data, offsets)
        n = np.diff(self.first)
        self.n_words = n
        size = np.diff(offsets)
        letters = _per_text(_LETTER[data], offsets)
        capitals, small = _per_text(_CAPITAL[data], offsets), _per_text(_SMALL[data], offsets)
        length = ends - starts
        last, second = data[ends - 1], data[np.maximum(ends - 2, starts)]
        self.shapes = (_KIND[data[starts]] * 6 + _KIND[last]) * 6 + _KIND[second] + 216 * np.minimum(length, 24)
        text_of = np.repeat(np.arange(len(n)), n)
        self.repeat = np.zeros(len(self.hashes), dtype=bool)
        self.repeat[1:] = (self.hashes[1:] == self.hashes[:-1]) & (text_of[1:] == text_of[:-1])
        distinct, lines = np.zeros(len(n), np.int64), np.ones((len(n), 2), np.int64)
        for i, text in enumerate(texts.to_pylist()):
            distinct[i] = len(np.unique(self.hashes[self.first[i]:self.first[i + 1]]))
            parts = [p for p in (text or "").split("\n") if p]
            lines[i] = len(set(parts)), len(parts)
        self.stats = np.stack([
            _ratio(_per_text(_SIGN[data], offsets), size),
            _ratio(capitals, capitals + small),
            _ratio(distinct, np.minimum(n, 400)),
            _ratio(lines[:, 0], lines[:, 1]),
            _ratio(_per_text(_SIGN[last] & _SIGN[second] & (length > 1), self.first), n),
            _ratio(_per_text(np.isin(self.hashes, _FUNCTION_HASHES), self.first), n),
            _ratio(letters, n),
            _ratio(_per_text(_STOP[last] & ~_SIGN[second], self.first), n),
            _ratio(_per_text(self.repeat, self.first), n),
        ], axis=1)
        self.n_lines = lines[:, 1]

    def votes(self) -> np.ndarray:
        signs, capitals, variety, lines, endings, common, length, sentences, runs = self.stats.T
        n = self.n_words
        rules = [  # bad where, good where
            (signs > 0.04, signs < 0.01, n >= 5),
            (capitals > 0.35, capitals < 0.15, n >= 20),
            (variety < 0.20, variety > 0.35, n >= 40),
            (lines < 0.55, lines > 0.9, self.n_lines >= 4),
            (endings > 0.15, endings < 0.02, n >= 5),
            (common < 0.02, common > 0.08, n >= 40),
            ((length < 2.0) | (length > 12.0), (length > 3.0) & (length < 9.0), n >= 10),
            (sentences < 0.004, (sentences > 0.02) & (sentences < 0.5), n >= 60),
            (runs > 0.10, runs < 0.04, n >= 20),
        ]
        return np.stack([np.where(~enough, NONE, np.where(bad, BAD, np.where(good, GOOD, NONE)))
                         for bad, good, enough in rules], axis=1)

    def patterns(self) -> np.ndarray:
        return self.votes() @ (3 ** np.arange(len(LABELLERS)))

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of every word (its text, its shape, whether it repeats) and of every text (coarse ratios)."""
        top = np.uint64(64 - BUCKETS.bit_length() + 1)
        shape = mix(self.shapes.astype(np.uint64) + np.uint64(1 << 40))
        repeat = mix(self.repeat.astype(np.uint64) + np.uint64(1 << 41))
        of_words = np.stack([self.hashes, shape, repeat], axis=1) >> top
        coarse = np.floor(np.clip(self.stats, 0, 15) * np.array([50, 10, 10, 10, 10, 25, 1, 25, 25])).astype(np.uint64)
        long_enough = np.minimum(np.log2(self.n_words + 1), 7).astype(np.uint64)[:, None]
        kinds = np.arange(coarse.shape[1], dtype=np.uint64)
        of_texts = mix(coarse + kinds * np.uint64(1000) + long_enough * np.uint64(100_000) + np.uint64(1 << 42)) >> top
        return of_words.astype(np.int64), of_texts.astype(np.int64)


_FUNCTION_HASHES = word_hashes(pa.array(FUNCTION_WORDS))[0]


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        facts = Facts(batch.column(1))
        codes = np.where(facts.n_words > 0, facts.patterns(), -1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes)], names=["r", "pattern"])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation: share of good, P(vote | class) per labeller, and each pattern's posterior of good.

    A labeller that says nothing says nothing of the class: short texts give few votes, whatever their quality.
    """
    votes = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    said = votes[:, :, None] == np.arange(2)
    good, bad = (votes == GOOD).sum(1), (votes == BAD).sum(1)
    posterior = np.where(bad >= 2, 0.1, np.clip((good + 1) / (good + 3 * bad + 1.2), 0.05, 0.95))
    prior, tables = 0.5, np.zeros((2, len(LABELLERS), 2))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        tables = np.einsum("cp,plv->clv", weight, said) + 0.5
        tables /= tables.sum(axis=2, keepdims=True)
        logs = np.einsum("plv,clv->cp", said, np.log(tables)) + np.log([1 - prior, prior])[:, None]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - posterior).max(initial=0) < 1e-9:
            break
        posterior = new
    return prior, tables, posterior


def _rows_of_features(batches: Iterator[pa.RecordBatch], labels: dict[int, float]) -> Iterator[pa.RecordBatch]:
    """(r, text) -> r, label, buckets, shares."""
    for batch in pieces(batches, 1):
        facts = Facts(batch.column(1))
        codes = facts.patterns()
        of_words, of_texts = facts.features()
        buckets, shares = [], []
        for i, (a, b) in enumerate(zip(facts.first[:-1], facts.first[1:])):
            own, times = np.unique(of_words[a:b], return_counts=True)
            buckets.append(np.concatenate([own, of_texts[i]]).astype(np.int32))
            shares.append(np.concatenate([times / max(b - a, 1), np.full(of_texts.shape[1], 0.3)]).astype(np.float32))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in buckets])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([labels[int(c)] for c in codes], pa.float64()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*buckets, np.zeros(0, np.int32)]))),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*shares, np.zeros(0, np.float32)]))),
        ], names=["r", "label", "buckets", "shares"])


def fit(labels: np.ndarray, buckets: list[np.ndarray], shares: list[np.ndarray]) -> np.ndarray:
    """Logistic regression on soft labels by adaptive stochastic gradients; the last weight is the bias."""
    weights, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    order = np.random.default_rng(5)
    bad = max((1 - labels).sum(), 1.0)
    balance = np.sqrt(max(labels.sum(), 1.0) / bad)  # half-way to equal weight of the classes
    for _ in range(EPOCHS):
        for rows in np.array_split(order.permutation(len(labels)), max(1, len(labels) // BATCH)):
            sizes = [len(buckets[r]) + 1 for r in rows]
            at = np.concatenate([np.append(buckets[r], BUCKETS) for r in rows])
            by = np.concatenate([np.append(shares[r], 1.0) for r in rows])
            of = np.repeat(np.arange(len(rows)), sizes)
            z = np.bincount(of, weights[at] * by, len(rows))
            y = labels[rows]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * (y + (1 - y) * balance) / len(rows)
            slope = np.bincount(at, error[of] * by, BUCKETS + 1) + DECAY * weights
            seen += slope * slope
            weights -= RATE * slope / np.sqrt(seen)
    return weights


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of weights from all rows of the sample."""
    labels, buckets, shares = [], [], []
    for batch in batches:
        labels += batch.column(1).to_pylist()
        for found, column in ((buckets, batch.column(2)), (shares, batch.column(3))):
            found += [x.values.to_numpy() for x in column]
    if labels:
        weights = fit(np.array(labels), buckets, shares)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()])], names=["weights"])


def _scored(batches: Iterator[pa.RecordBatch], weights: np.ndarray, labels: dict[int, float],
            threshold: float, at: int) -> Iterator[pa.RecordBatch]:
    # the text beside the document, to cut by
    with_text = (pa.RecordBatch.from_arrays([b.column(0), b.column(0).flatten()[at].cast(pa.string())],
                                            names=["_doc", "text"]) for b in batches)
    for batch in pieces(with_text, 1):
        facts = Facts(batch.column(1))
        of_words, of_texts = facts.features()
        each = weights[of_words].sum(axis=1)
        sums = np.zeros(len(each) + 1)
        np.cumsum(each, out=sums[1:])
        z = _ratio(sums[facts.first[1:]] - sums[facts.first[:-1]], facts.n_words)
        z += 0.3 * weights[of_texts].sum(axis=1) + weights[BUCKETS]
        score = np.where(facts.n_words > 0, np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6), 0.0)
        label = [round(labels.get(int(c), 0.5), 6) if n else 0.0 for c, n in zip(facts.patterns(), facts.n_words)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(facts.n_words), pa.array(label, pa.float64()), pa.array(score),
             pa.array(score >= threshold)], names=["_doc", "n_words", "label", "score", "kept"])


def _body(docs: DataFrame, text: str) -> Column:
    return F.col(f"`{text}`").cast("string")


def sampled_features(rows: DataFrame, labels: dict[int, float], sample: int, n: int) -> DataFrame:
    """rows(r, t), n of them with words -> r, label, buckets, shares of those whose hash r falls into the sample's share.

    Equal rows have one hash and count once, so a row that a third of the table repeats doesn't swell the sample.
    """
    share = int(min(sample / max(n, 1), 1) * (1 << 60)) + 1
    chosen = rows.filter((F.pmod("r", F.lit(1 << 60)) < share) & F.col("t").rlike(r"[^\x20\x09-\x0D]"))
    return chosen.distinct().mapInArrow(
        partial(_rows_of_features, labels=labels), "r long, label double, buckets array<int>, shares array<float>")


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, sample: int = SAMPLE,
            threshold: float = THRESHOLD) -> DataFrame:
    """Every document as `_doc` with n_words, label (posterior of good), score, and whether it is kept."""
    fixed = F.xxhash64(F.col(f"`{doc_id}`").cast("string"), _body(docs, text), F.lit("sample"))
    rows = cut_lineage(docs.select(fixed.alias("r"), _body(docs, text)).mapInArrow(_patterns, "r long, pattern long"))
    counted = rows.filter("pattern >= 0").groupBy("pattern").count().toPandas()  # at most 3**9 rows
    patterns, counts = counted["pattern"].to_numpy(), counted["count"].to_numpy()
    labels = dict(zip(patterns.tolist(), estimate(patterns, counts)[2].tolist()))
    learned = sampled_features(docs.select(fixed.alias("r"), _body(docs, text).alias("t")), labels, sample, int(counts.sum()))
    # one order, so that a repeated task fits the same weights; one row, or none
    fitted = learned.repartition(1).sortWithinPartitions("r").mapInArrow(_fitted, "weights array<double>").collect()
    weights = np.array(fitted[0]["weights"]) if fitted else np.zeros(BUCKETS + 1)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    schema = StructType([*whole.schema.fields, StructField("n_words", LongType()), StructField("label", DoubleType()),
                         StructField("score", DoubleType()), StructField("kept", BooleanType())])
    return whole.mapInArrow(partial(_scored, weights=weights.astype(np.float32), labels=labels, threshold=threshold,
                                    at=docs.columns.index(text)), schema)


def good_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    return quality(docs, **options).filter("kept").select("_doc.*")
