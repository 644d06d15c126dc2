"""Fill-in-the-middle examples against a plain reading of the rules, and the block tree against slices."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import fim
from codeloom.llm.words import buffers
from tests.llm.samples import documents, frame

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text, plain=90, spm=20):
    text = text or ""
    units = UNIT.findall(text)
    shown = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(shown[k:k + 8], 16) for k in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return doc_id, len(units), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return doc_id, len(units), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def texts():
    rnd = random.Random(8)
    marks = ["a <P> b", "<S>", "x<M>", "<P", "S>", "<", ">", "<<P", "P><S", "M>M>", "<S <M <P"]
    odd = ["", None, "\n", "\r\n\x00", "é", "é", "🙂" * 300, "a" * 9000, " " * 3000, "wörd" * 900, "ab1" * 2000 + "z"]
    mixed = ["".join(rnd.choice(["a", "bC", " ", "é", "🙂", "<", "P", ">", "1"]) for _ in range(rnd.randrange(80))) for _ in range(400)]
    return [*enumerate([*marks, *odd, *mixed], -20)]


@pytest.mark.parametrize("block", [1, 2, 7, 1024])
def test_examples_equal_brute_force(spark, block):
    rows = [(k, t, "en", "s", 1, "d", 1, 2, "k", 3, 4) for k, t in texts()] + documents()
    got = fim.fill_in_middle(frame(spark, rows), block=block)
    want = [brute(r[0], r[1]) for r in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_outputs_give_the_text_back(spark):
    rows = [(k, t, "en", "s", 1, "d", 1, 2, "k", 3, 4) for k, t in texts()] + documents()
    for plain, spm in ((100, 0), (100, 100), (0, 50)):
        shown = fim.fill_in_middle(frame(spark, rows), plain=plain, spm=spm)
        back = shown.select("doc_id", fim.restored(shown.output, shown.form).alias("text")).collect()
        assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_block_tree_finds_every_unit(block):
    for _, text in texts():
        data, offsets = buffers(pa.array([text]))
        begins, leads = fim._flags(data, offsets)
        tree = fim.BlockTree(begins, leads, block)
        units = UNIT.findall(text or "")
        assert tree.n == len(units)
        at = np.cumsum([0, *map(len, units)])
        for k in range(0, len(units) + 1, 1 + len(units) // 50):
            chars = int(at[k])
            assert tree.find(k) == (len((text or "")[:chars].encode()), chars)


def test_units_do_not_run_over_document_borders(spark):
    df = frame(spark, [(k, "abc", "en", "s", 1, "d", 1, 2, "k", 3, 4) for k in range(50)])
    assert {r.n for r in fim.fill_in_middle(df).collect()} == {1}


def test_empty_table_and_other_names(spark):
    assert fim.digests(fim.fill_in_middle(frame(spark, []))).collect() == []
    df = spark.createDataFrame([(4, "some words, here")], "output long, form string")
    row = fim.digests(fim.fill_in_middle(df, doc_id="output", text="form")).collect()[0]
    assert row.doc_id == 4 and row.n == 6 and row.restored_sha256 == hashlib.sha256(b"some words, here").hexdigest()
