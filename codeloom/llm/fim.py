"""Fill-in-the-middle examples: a text is cut at two unit borders and its parts are dealt anew between marks.

Units are `[A-Za-z]+|[^A-Za-z]`, read from left to right. A text lies in blocks of `block` bytes; a Fenwick tree over
the blocks holds how many units begin and how many code points lie in each. A cut is a unit number: a
binary-lifting descent finds the block in which that unit begins and the code points before it, and only
this block is searched for the place. All is read off the UTF-8 bytes; no text is taken apart into units.

Which cuts and which form a document gets follows from its id alone, so a lost task gives the same rows again.
`plain` texts stay as they are; `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle. A text that
holds one of the marks stays plain, so `restored` always gives back the text itself.

Defined cases: null and empty texts are plain, with n = 0; a null id counts as the empty string; rows are independent,
so repeated rows give repeated results and an empty table an empty one; other columns are not read.
"""

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm.words import buffers, pieces

# fixed values: marks before prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_P, _S, _M = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
BLOCK = 1024
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class BlockTree:
    """Fenwick tree over the blocks of one text, with unit and code-point counts in each node."""

    def __init__(self, begins: np.ndarray, leads: np.ndarray, block: int):
        """begins, leads: for each byte, whether a unit and whether a code point begins there."""
        self.begins, self.leads, self.block = begins, leads, block
        at = np.arange(0, len(begins), block)
        sums = np.zeros((len(at) + 1, 2), dtype=np.int64)
        if len(at):
            sums[1:, 0] = np.add.reduceat(begins, at, dtype=np.int64)
            sums[1:, 1] = np.add.reduceat(leads, at, dtype=np.int64)
        sums = np.cumsum(sums, axis=0)
        node = np.arange(len(sums))
        self.n = int(sums[-1, 0])
        # a node covers as many blocks as its lowest set bit says
        self.nodes = (sums - sums[node & (node - 1)]).tolist()

    def find(self, unit: int) -> tuple[int, int]:
        """Byte and code point at which the unit begins; the end of the text for unit n."""
        at, chars, size = 0, 0, len(self.nodes) - 1
        step = 1 << (size.bit_length() - 1) if size else 0
        while step:
            if at + step <= size and self.nodes[at + step][0] <= unit:
                at += step
                unit -= self.nodes[at][0]
                chars += self.nodes[at][1]
            step >>= 1
        start = at * self.block
        if start >= len(self.begins):
            return len(self.begins), chars
        place = int(np.flatnonzero(self.begins[start:start + self.block])[unit])
        return start + place, chars + int(np.count_nonzero(self.leads[start:start + place]))


def _flags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of all texts, whether a unit begins there and whether a code point does."""
    leads = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    inner = np.zeros(len(data), dtype=bool)
    inner[1:] = letter[1:] & letter[:-1]
    inner[offsets[:-1][np.diff(offsets) > 0]] = False
    return leads & ~inner, leads


def _draws(seed: str, doc_id: int | None) -> list[int]:
    shown = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(shown[k:k + 8], 16) for k in range(0, 32, 8)]


def _examples(batches: Iterator[pa.RecordBatch], seed: str, plain: int, spm: int, block: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        ids = batch.column(0).cast(pa.int64())
        data, offsets = buffers(batch.column(1))
        begins, leads = _flags(data, offsets)
        rows, outputs = [], []
        for doc_id, a, b in zip(ids.to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            text = data[a:b].tobytes()
            h1, h2, h3, h4 = _draws(seed, doc_id)
            tree = BlockTree(begins[a:b], leads[a:b], block)
            if not text or h3 % 100 >= plain or _P in text or _S in text or _M in text:
                rows.append((tree.n, "plain", None, None))
                outputs.append(text)
                continue
            first, second = sorted((h1 % (tree.n + 1), h2 % (tree.n + 1)))
            (x, before), (y, until) = tree.find(first), tree.find(second)
            form = "spm" if h4 % 100 < spm else "psm"
            rows.append((tree.n, form, before, until - before))
            parts = (_S, text[y:], _P, text[:x]) if form == "spm" else (_P, text[:x], _S, text[y:])
            outputs.append(b"".join((*parts, _M, text[x:y])))
        ends = np.cumsum([0, *map(len, outputs)]).astype(np.int64)
        shown = pa.LargeStringArray.from_buffers(len(outputs), pa.py_buffer(ends), pa.py_buffer(b"".join(outputs)))
        n, form, before, middle = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()),
             pa.array(middle, pa.int64()), shown.cast(pa.string())],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: str = "1", plain: int = 90, spm: int = 20, block: int = BLOCK,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (units of the text), form, prefix_chars, middle_chars (null if plain), output.

    Of a hundred documents, about 100 - `plain` stay plain by the draw, and `spm` of the others take that form.
    """
    keyed = docs.select(F.col(f"`{doc_id}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("v"))
    return keyed.mapInArrow(partial(_examples, seed=seed, plain=plain, spm=spm, block=block), _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made from.

    The parts hold no mark, and a mark begins with `<` and ends with `>`, so none can arise where two parts meet.
    """
    front = F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)

    def parts(second: str) -> tuple[Column, Column]:
        left = F.substring_index(front, second, 1)
        return F.substr(left, F.lit(4)), F.substring_index(front, second, -1)

    prefix, suffix = parts(SUFFIX)
    late_suffix, late_prefix = parts(PREFIX)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(late_prefix, middle, late_suffix)).otherwise(output))


def digests(examples: DataFrame) -> DataFrame:
    """The columns of `fill_in_middle` with digests of the output and of the text rebuilt from it."""
    return examples.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
