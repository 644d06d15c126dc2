"""BPE encoding and decoding by batched numpy merge rounds.

Texts are cut into words (special strings, normal form, lower case, word pattern); each distinct word of a batch is
encoded once. The byte symbols of all new words lie in one flat array. A round looks up the keys of all
neighbouring pairs by binary search in the sorted pair keys, takes the lowest rank of every word, merges it, and
drops words that have no pair left.

Where a merge's result takes part only in later merges, all its places in a word are merged in one round, from the
left without overlap; otherwise only the leftmost, as the sequential rule has it. So a very long word takes at
most as many rounds as it has different merges.

Letters and numbers are those of the installed Unicode tables; code points that these leave unassigned count as
other signs.

Ids turn into text as the vocabulary file asks: without a decoder part, token strings joined by one space.
Defined cases: null and empty texts have no tokens and decode to an empty text; rows are independent, so repeated
rows give repeated results and an empty table an empty one; other columns are not read.
"""

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.words import pieces

VOCABULARY = "word_bpe_49k.json"
#: words kept encoded by one task
CACHE = 120_000
_NONE = np.iinfo(np.int64).max
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def vocabulary(name: str = VOCABULARY) -> str:
    """Place of an installed vocabulary file."""
    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones themselves, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _supported(spec: dict) -> None:
    model = spec["model"]
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if (model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None
            or spec["post_processor"] is not None or model["unk_token"] is not None
            or model["continuing_subword_prefix"] is not None):
        raise ValueError("the vocabulary file asks for steps that this encoder doesn't have")


class Encoder:
    """Encodes and decodes with one vocabulary file; holds the words it has met, at most CACHE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _supported(spec)
        vocab, merges, suffix = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(pattern.replace("\\s", _WHITE))
        shown = byte_characters()
        self.inner = np.array([vocab[c] for c in shown], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in shown], dtype=np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        first_use = np.full(self.width, _NONE)
        np.minimum.at(first_use, left, np.arange(len(pairs)))
        np.minimum.at(first_use, right, np.arange(len(pairs)))
        self.everywhere = first_use[self.result] > np.arange(len(pairs))
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.id_text: list[str] = []
        self.shown: list[str] = []
        for content, i in self.special.items():
            self._add(content, np.array([i]))

    def _add(self, word: str, ids: np.ndarray) -> None:
        self.rows[word] = len(self.ids)
        numbers = ids.tolist()
        self.ids.append(ids)
        self.id_text.append(" ".join(map(str, numbers)))
        self.shown.append(self.decode(numbers))

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])

    def words(self, text: str) -> list[str]:
        found = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                found.append(part)
            elif part:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                found += self.word.findall(part)
        return found

    def learn(self, words: list[str]) -> None:
        """Encode words not met before, all in one flat array."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.final[data[ends - 1]]
        for word, ids in zip(words, self.merged(symbols, sizes)):
            self._add(word, ids)

    def merged(self, symbols: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        done: list[np.ndarray] = [symbols[:0]] * len(sizes)
        names = np.arange(len(sizes))
        while len(symbols):
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            word = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.full(len(symbols), _NONE)
            keys = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = (self.keys[at] == keys) & (word[:-1] == word[1:])
            rank[:-1][hit] = self.ranks[at[hit]]
            best = np.minimum.reduceat(rank, first)
            ended = best == _NONE
            for k in np.flatnonzero(ended).tolist():
                done[names[k]] = symbols[first[k]:first[k] + sizes[k]]
            places = np.flatnonzero((rank == best[word]) & ~ended[word])
            if len(places):
                chosen = rank[places]
                # neighbouring places hold the same pair of equal symbols: every other one, from the left
                fresh = np.concatenate([[True], np.diff(places) > 1])
                start = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
                take = (np.arange(len(places)) - start) % 2 == 0
                leading = np.concatenate([[True], word[places][1:] != word[places][:-1]])
                take &= self.everywhere[chosen] | leading
                places, chosen = places[take], chosen[take]
                symbols[places] = self.result[chosen]
            keep = ~ended[word]
            keep[places + 1] = False
            sizes = np.bincount(word[keep], minlength=len(sizes))[~ended]
            symbols, names = symbols[keep], names[~ended]
        return done

    def rows_of(self, texts: list[str]) -> list[list[int]]:
        """For each text the rows of its words."""
        found = [self.words(t) for t in texts]
        if len(self.ids) > CACHE:
            self.forget()
        new = list(set(chain.from_iterable(found)).difference(self.rows))
        for k in range(0, len(new), 50_000):
            self.learn(new[k:k + 50_000])
        return [list(map(self.rows.__getitem__, words)) for words in found]

    def encode(self, text: str) -> list[int]:
        return [int(i) for r in self.rows_of([text])[0] for i in self.ids[r]]


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for batch in pieces(batches, 1):
        counts, ids, shown = [], [], []
        for rows in encoder.rows_of([t or "" for t in batch.column(1).to_pylist()]):
            counts.append(sum([len(encoder.ids[r]) for r in rows]))
            ids.append(sha(" ".join([encoder.id_text[r] for r in rows])))
            shown.append(sha(" ".join([encoder.shown[r] for r in rows])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
             pa.array(shown, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _token_ids(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    for batch in pieces(batches, 1):
        found = encoder.rows_of([t or "" for t in batch.column(1).to_pylist()])
        ids = [np.concatenate([encoder.ids[r] for r in rows]).astype(np.int32) if rows else np.zeros(0, np.int32)
               for rows in found]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(np.diff(ends).astype(np.int64)),
             pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "n_tokens", "token_ids"])


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    for batch in batches:
        shown = [encoder.decode(ids or []) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(shown, pa.string())],
                                         names=["doc_id", "text"])


def _keyed(docs: DataFrame, doc_id: str, column: str, kind: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("k"), F.col(f"`{column}`").cast(kind).alias("v"))


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, token_ids of every whole text."""
    return _keyed(docs, doc_id, text, "string").mapInArrow(
        partial(_token_ids, path=path or vocabulary()), "doc_id long, n_tokens long, token_ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, doc_id: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """doc_id and the text that the ids stand for; null ids give an empty text."""
    return _keyed(encoded, doc_id, ids, "array<int>").mapInArrow(partial(_texts, path=path or vocabulary()), "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text they decode to."""
    return _keyed(docs, doc_id, text, "string").mapInArrow(
        partial(_digests, path=path or vocabulary()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
