"""Exact and near dedup against brute force."""

import hashlib
import random
from collections import defaultdict
from itertools import combinations

import pytest

from codeloom.llm import chosen_path as cp, exact_dedup as ed
from codeloom.llm.components import _round, components
from codeloom.llm.words import word_hashes
from codeloom.session import spared_driver
from tests.llm.samples import WHITE, documents, frame, prose, words


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[WHITE.sub("", t or "")].append((-len(t or ""), i is None, i or 0))
    out = []
    for body, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        taken = False
        for m in sorted(members):
            first = m == best and not taken
            taken |= first
            out.append((None if m[1] else m[2], keep, len(members), first, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("counters", [256, 4])
def test_exact_duplicates_equal_brute_force(spark, monkeypatch, counters):
    monkeypatch.setattr(ed, "COUNTERS", counters)
    rows = documents() + [(500 + k, "hot  text", "en", "s", 1, "d", 1, 2, "k", 3, 4) for k in range(90)]
    got = ed.exact_duplicates(frame(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(rows)
    kept = ed.drop_exact_duplicates(frame(spark, rows).repartition(3))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r.doc_id, WHITE.sub("", r.text or "")) for r in kept.collect() if r.doc_id is not None) == sorted(
        (i, WHITE.sub("", t or "")) for i, t in {(x[0], y[1]) for x in brute_exact(rows) if x[3]
                                                for y in rows if y[0] == x[0] and hashlib.sha256(
                                                    WHITE.sub("", y[1] or "").encode()).hexdigest() == x[4]} if i is not None)


def test_exact_duplicates_of_nothing(spark):
    none = frame(spark, [])
    assert ed.exact_duplicates(none).collect() == [] and ed.drop_exact_duplicates(none).collect() == []


def shingles(text):
    w = words(text)
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("limit", [8, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(cp, "LIMIT", limit)
    rnd = random.Random(3)
    rows = documents()
    chain = prose(rnd, 80).split()  # a chain of links whose ends are far apart
    for i in range(300, 330):
        chain[rnd.randrange(80)] = f"c{i}"
        rows.append((i, " ".join(chain), "en", "s", 1, "d", 1, 2, "k", 3, 4))
    half = prose(rnd, 60)  # texts that share a long passage and are not linked
    rows += [(400 + i, half + " " + prose(rnd, 45), "en", "s", 1, "d", 1, 2, "k", 3, 4) for i in range(40)]
    got = cp.near_duplicates(frame(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == brute_near(rows)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    kept = cp.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i, v in brute_near(rows).items() if v[2]}


def test_borderline_pairs_are_decided_on_full_sets(spark):
    w = [f"w{i}" for i in range(200)]
    pairs = []
    for k, n in enumerate((10, 11, 12, 13, 14, 24, 25, 26, 27, 28)):  # tails of different length
        text = [f"{k}_{x}" for x in w]
        pairs += [(10 * k, " ".join(text[:100])), (10 * k + 1, " ".join(text[n:100 + n]))]
    rows = [(i, t, "en", "s", 1, "d", 1, 2, "k", 3, 4) for i, t in pairs]
    got = {r.doc_id: r.component_id for r in cp.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: v[1] for i, v in brute_near(rows).items()}
    assert len(set(got.values())) not in (len(rows), len(rows) // 2)


def test_near_duplicates_of_nothing(spark):
    assert cp.near_duplicates(frame(spark, [])).collect() == []
    assert cp.drop_near_duplicates(frame(spark, [])).collect() == []


def test_any_column_name_may_be_there_already(spark):
    df = frame(spark, documents()).withColumnRenamed("_x", "_gone").withColumnRenamed("row", "_GONE_")
    kept = cp.drop_near_duplicates(df)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()


@pytest.mark.parametrize("block", [256, 2])
def test_links_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(cp, "BLOCK", block)
    rows = documents(5, 40)
    got = cp.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == brute_near(rows)


def family(rnd, n, size, changed):
    """n texts of one base, each with its own words at `changed` places of `size`."""
    base = [f"b{i}" for i in range(size)]
    for k in range(n):
        words = list(base)
        for at in rnd.sample(range(size), changed):
            words[at] = f"x{k}_{at}"
        yield " ".join(words)


def test_recall_on_a_crowded_set_of_isolated_pairs(spark):
    """300 texts of one base, no two of them linked, and to forty of them a partner at 0.75 to 0.80: all are found."""
    rnd = random.Random(12)
    rows = list(enumerate(family(rnd, 300, 160, 6)))
    pairs = 0
    for i in range(40):
        words = rows[i][1].split()
        for at in rnd.sample(range(0, 160, 8), 3):
            words[at] = f"y{i}_{at}"
        rows.append((1000 + i, " ".join(words)))
    rows = [(i, t, "en", "s", 1, "d", 1, 2, "k", 3, 4) for i, t in rows]
    want = brute_near(rows)
    pairs = sum(want[1000 + i][1] != 1000 + i for i in range(40))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in cp.near_duplicates(frame(spark, rows)).collect()}
    assert pairs > 20 and len({v[1] for v in want.values()}) > 200
    assert got == want


def test_rounds_free_what_the_driver_holds(spark, monkeypatch):
    freed = []
    monkeypatch.setattr("codeloom.llm.components.tidy", freed.append)
    components(spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long"))
    assert len(freed) > 1


def test_components_end_without_a_round_that_changes_nothing(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr("codeloom.llm.components._round", lambda edges, f=_round: rounds.append(1) or f(edges))
    stars = [(k, 1) for k in range(2, 40)] + [(51, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert got == {k: 1 for k in range(1, 40)} | {50: 50, 51: 50} and not rounds
    path = spark.createDataFrame([(1, 2), (2, 3), (4, 3)], "u long, v long")
    assert {r.node: r.component for r in components(path).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert rounds
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_rounds_send_no_finished_exchange_through_the_driver(spark, monkeypatch):
    """Joins of two exchanges stay joins of two exchanges while links are found; the settings are the user's again after."""
    keys = ["spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.ui.explainMode"]
    seen = []
    monkeypatch.setattr(cp, "components", lambda edges: seen.append([spark.conf.get(k) for k in keys]) or components(edges))
    spark.conf.set(keys[0], "1m")
    try:
        cp.near_duplicates(frame(spark, documents())).collect()
        assert seen and all(x == ["-1", "simple"] for x in seen)
        assert spark.conf.get(keys[0]) == "1m"
    finally:
        spark.conf.unset(keys[0])
    with pytest.raises(ValueError), spared_driver(spark):
        raise ValueError
    assert spark.conf.get(keys[0], None) is None


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(200, 260)] + [(5, 5), (9, 8), (8, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {k: 1 for k in (1, *range(200, 260))} | {8: 8, 9: 8}
    assert got == want


def test_word_hashes_follow_the_word_rule(monkeypatch):
    import pyarrow as pa

    from codeloom.llm import words as module

    texts = [t for _, t, *_ in documents()] + ["a\x0bb\x0cc\x85d", "x" * 300 + " Y"]
    seen = {}
    for window in (1 << 20, 64):
        monkeypatch.setattr(module, "WINDOW", window)
        hashes, first = word_hashes(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            own = words(t)
            assert len(own) == first[i + 1] - first[i]
            for w, h in zip(own, hashes[first[i]:first[i + 1]]):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_nothing_is_collected_or_crossed(spark):
    plan = ed.exact_duplicates(frame(spark, documents()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_trees_keep_a_pair_at_the_threshold_in_crowded_nodes():
    """Computed miss of an isolated pair whose common nodes are all branched, over its number of equal tokens."""
    from math import comb

    def missed(same, levels):
        whole = 0.0
        for t in range(cp.LEAST_EQUAL, cp.TOKENS + 1):
            p, none = t / cp.TOKENS, 0.0
            for _ in range(levels):  # no common place below a common node
                none = (1 - p**cp.STEP + p**cp.STEP * none) ** cp.BRANCHES
            whole += comb(cp.TOKENS, t) * same**t * (1 - same) ** (cp.TOKENS - t) * (1 - same + same * none) ** cp.ROOTS
        return whole

    for levels in range(12):
        assert missed(0.75, levels) < 1e-5 and missed(0.80, levels) < 1e-6
