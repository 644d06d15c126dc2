"""MinHash near-dedup by the chosen-path set similarity join.

A document's set is its distinct 5-word shingles as 64-bit hashes. Equal sets collapse to one representative.
Every representative starts in TREES independent trees; in a node it is branched by the value of minwise tokens
at positions that a hash of the node selects, so only documents with equal tokens meet in a child. A node of at
most `limit` documents is compared exhaustively. In a larger node all documents are compared with ANCHORS of
them. It ends when one component holds all its documents, as equal components need no further link, or when so
few are outside its largest component that these can be compared with all; else it is branched again.

Below the roots a node has BRANCHES children of STEP tokens: a pair at the threshold expects 3 * 0.75**2 = 1.69 common
children in a common node, so its common places grow from level to level, and documents with less in common part.
`limit` grows from level to level, so every node ends up compared or in one component; no node is cut short and no
group is gathered in one task.

Places are short rows; a document's tokens join them only where they are compared or branched. Candidates whose
lengths or tokens rule out the threshold go (tokens: a link is missed with probability below 1e-5); all others are
confirmed on the full sets. For that, documents of one root token form blocks of about BLOCK, and a pair of blocks is
sent each set that it asks for once, however many pairs ask. A pair at the threshold that no other document links has
no common place left with a probability of 0.25**ROOTS = 4e-9 at the roots, and, computed over its number of equal
tokens, with less than 1e-5 after any number of levels of nodes too large to be compared (tested).

Defined cases: null and empty texts have no shingles and no links; null ids are never linked and keep
component null; rows that repeat an id with equal words are one document; an empty table gives an empty one.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.llm.components import components
from codeloom.llm.words import mix, pieces, shingle_sets
from codeloom.session import spared_driver, tidy, written

SHINGLE = 5
PERCENT = 75
TREES = 7
#: children of a root, and tokens that choose them, one each
ROOT_BRANCHES = 2
ROOTS = TREES * ROOT_BRANCHES
#: tokens of one byte for deeper nodes and estimates; two that differ look alike in one of 256 cases
TOKENS = 256
#: below the roots a node has so many children, each named by so many tokens
BRANCHES = 3
STEP = 2
#: documents of a node that all others are compared with; nodes of at most LIMIT are compared exhaustively
ANCHORS = 2
LIMIT = 8
#: the limit grows by this factor from level to level
MORE = 3
#: of TOKENS equal tokens, a pair at the threshold has fewer with probability below 1e-5
LEAST_EQUAL = 161
#: documents in a block whose sets travel together
BLOCK = 256

_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, ROOTS + TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNATURES = "doc_id long, n_shingles long, key1 long, key2 long, roots array<int>, tokens array<tinyint>"


def _lists(rows: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))


def signatures_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        n = batch.num_rows
        sizes, keys = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
        low = np.zeros((n, len(_SEEDS)), np.uint64)
        for i, grams in enumerate(shingle_sets(batch.column(1), size)):
            if len(grams):
                sizes[i] = len(grams)
                keys[i] = grams.sum(dtype=np.uint64), mix(grams ^ _SEEDS[0]).sum(dtype=np.uint64)
                for a in range(0, len(grams), 4096):  # bounded work space for long texts
                    least = (grams[a:a + 4096, None] * _SEEDS).min(axis=0)
                    low[i] = least if a == 0 else np.minimum(low[i], least)
        low = mix(low)
        signed = keys.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(sizes), pa.array(signed[:, 0].copy()),
             pa.array(signed[:, 1].copy()), _lists(low[:, :ROOTS].astype(np.uint32).view(np.int32)),
             _lists(low[:, ROOTS:].astype(np.uint8).view(np.int8))],
            names=["doc_id", "n_shingles", "key1", "key2", "roots", "tokens"])


def sets_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        grams = list(shingle_sets(batch.column(1), size))
        ends = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
        flat = np.concatenate([*grams, np.zeros(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            names=["doc_id", "grams"])


def _roots(sets: DataFrame) -> DataFrame:
    """(doc, node): the children of the roots; trees select different tokens."""
    child = F.transform("roots", lambda token, j: F.xxhash64(j, token))
    return sets.select("doc", F.explode(child).alias("node"))


def _with_facts(places: DataFrame, facts: DataFrame) -> DataFrame:
    """Add n and tokens of each document; only those of the documents asked for are dealt out."""
    return places.join(facts.join(places.select("doc").distinct(), "doc", "left_semi"), "doc")


def _branch(places: DataFrame, facts: DataFrame) -> DataFrame:
    """Children of each (doc, component, node): where the document's tokens at positions chosen by the node lead."""
    def token(j: Column, k: int) -> Column:
        return F.col("tokens")[F.pmod(F.xxhash64("node", j, F.lit(k)), F.lit(TOKENS)).cast("int")]

    child = F.transform(F.sequence(F.lit(1), F.lit(BRANCHES)),
                        lambda j: F.xxhash64("node", j, *[token(j, k) for k in range(STEP)]))
    return _with_facts(places.select("doc", "component", "node"), facts).select(
        "doc", "component", F.explode(F.array_distinct(child)).alias("node"))


def _equal_tokens(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _may_link(a: str, b: str) -> Column:
    sizes = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * PERCENT
    return sizes & (_equal_tokens(F.col(f"{a}.tokens"), F.col(f"{b}.tokens")) >= LEAST_EQUAL)


def _linked(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Those of the pairs (u, v) of two blocks whose sets (doc, grams) reach the threshold."""
    held: dict[int, list[np.ndarray]] = {}
    column = sets.column("grams").combine_chunks()
    for doc, grams in zip(sets.column("doc").to_pylist(), column):
        held.setdefault(doc, []).append(grams.values.to_numpy().view(np.uint64))  # sorted
    kept = []
    for u, v in zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist()):
        for a in held.get(u, []):
            for b in held.get(v, []):
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int(np.count_nonzero(large[at] == small))
                if both * 100 >= (len(a) + len(b) - both) * PERCENT:
                    kept.append((u, v))
    return pa.table({"u": pa.array([u for u, _ in kept], pa.int64()), "v": pa.array([v for _, v in kept], pa.int64())})


def _confirmed(pairs: DataFrame, docs: DataFrame, families: DataFrame, size: int) -> DataFrame:
    """Those of the pairs (u, v) whose full sets reach the threshold; families(doc, family) says who shares blocks."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc")).distinct()
    placed = ids.join(families, "doc")
    parts = placed.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    blocks = placed.join(parts, "family").select("doc", F.xxhash64("family", F.pmod(F.xxhash64("doc"), F.col("k"))).alias("block"))
    keyed = written(
        pairs.join(blocks.select(F.col("doc").alias("u"), F.col("block").alias("a")), "u")
        .join(blocks.select(F.col("doc").alias("v"), F.col("block").alias("b")), "v").select(F.xxhash64("a", "b").alias("key"), "u", "v"))
    tidy(keyed.sparkSession)
    wanted = keyed.select("key", F.col("u").alias("doc")).unionByName(keyed.select("key", F.col("v").alias("doc"))).distinct()
    sets = docs.join(ids.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi").mapInArrow(
        partial(sets_of, size=size), "doc_id long, grams array<long>").filter(F.size("grams") > 0)
    sent = wanted.join(sets.withColumnRenamed("doc_id", "doc"), "doc").select(F.col("key").alias("part"), "doc", "grams")
    return keyed.groupBy("key").cogroup(sent.groupBy("part")).applyInArrow(_linked, "u long, v long").distinct()


def _candidates(members: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """Pairs (u, v) of different components to confirm.

    In a node that ends here (`small`) those that `stand` are compared with all; in others ANCHORS documents are.
    """
    # the lowest hashes stand for a larger node, the same documents wherever they meet: an exact share of hash
    # space, then a rank in what is left
    code = F.pmod(F.xxhash64("doc", F.lit(limit)), F.lit(1 << 30))
    share = members.withColumn("code", code).filter(
        F.when(F.col("small"), F.col("stand")).otherwise(F.col("code") * F.col("size") < F.lit(8 * ANCHORS << 30)))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("code", "doc"))
    chosen = share.withColumn("rank", rank).filter(F.col("small") | (F.col("rank") <= ANCHORS))
    a, b = _with_facts(chosen, facts).alias("a"), _with_facts(members, facts).alias("b")
    apart = (F.col("a.component") != F.col("b.component")) & (F.col("a.doc") != F.col("b.doc"))
    once = ~(F.col("b.small") & F.col("b.stand")) | (F.col("a.doc") < F.col("b.doc"))
    return a.join(b, (F.col("a.node") == F.col("b.node")) & apart & once & _may_link("a", "b")).select(
        F.least("a.doc", "b.doc").alias("u"), F.greatest("a.doc", "b.doc").alias("v")).distinct()


def _counted(spots: DataFrame, limit: int) -> DataFrame:
    """Spots of nodes that several documents share; nodes of at most `limit` end here."""
    crowded = spots.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    return spots.join(crowded, "node").withColumns({"small": F.col("size") <= limit, "stand": F.lit(True)})


def _mixed(members: DataFrame, limit: int) -> DataFrame:
    """(node, size, small, top) of nodes whose documents aren't in one component.

    `small`: pairs of different components are at most `limit` for each document, so the documents outside the
    largest component, `top`, can be compared with all others.
    """
    parts = members.groupBy("node", "component").agg(F.count("*").alias("c"))
    nodes = parts.groupBy("node").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("same"),
                                      F.max_by("component", "c").alias("top"))
    apart = F.col("size") * F.col("size") - F.col("same")
    return nodes.filter(apart > 0).select("node", "size", (apart <= F.col("size") * limit).alias("small"), "top")


def links(sets: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Components (node, component) of the representatives `sets` (doc, n, roots, tokens) that have a link."""
    columns = ["doc", "component", "node", "size", "small", "stand"]
    facts, families = sets.select("doc", "n", "tokens"), sets.select("doc", F.col("roots")[0].alias("family"))
    members = _counted(_roots(sets), LIMIT).withColumn("component", F.col("doc"))
    found, tested, limit = None, None, LIMIT
    while True:
        members = written(members.select(*columns))
        tidy(members.sparkSession)
        pairs = _candidates(members, facts, limit)
        pairs = written(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"))
        tidy(pairs.sparkSession)
        tested = pairs if tested is None else tested.unionByName(pairs)
        edges = _confirmed(pairs, docs, families, size)
        if found is not None:
            edges = edges.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v")))
        found = components(edges)
        limit *= MORE
        now = members.filter("NOT small").select("doc", "node").join(
            found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        places = written(now.join(_mixed(now, limit), "node"))
        if places.isEmpty():
            return found
        ending = places.filter("small").withColumn("stand", F.col("component") != F.col("top"))
        members = _counted(_branch(places.filter("NOT small"), facts), limit).select(*columns).unionByName(ending.select(*columns))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest linked id), kept."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = written(docs.mapInArrow(partial(signatures_of, size=size), _SIGNATURES))
    own = ["key1", "key2", "n_shingles"]
    linked = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = written(linked.groupBy(*own, "roots", "tokens").agg(F.min("doc_id").alias("doc")))
    with spared_driver(docs.sparkSession):
        found = links(sets.select("doc", F.col("n_shingles").alias("n"), "roots", "tokens"),
                      docs.filter("doc_id IS NOT NULL"), size)
    named = sets.select(*own, "doc").join(found.withColumnRenamed("node", "doc"), "doc", "left").select(
        *own, F.coalesce("component", "doc").alias("component"))
    out = rows.drop("roots", "tokens").join(named, own, "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, one of each group, with the columns they came with."""
    name = "_gone"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    gone = near_duplicates(docs, doc_id, text).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{doc_id}`").cast("long") == F.col(name), "left_anti")
