"""Exact dedup with a heavy-hitter split (native).

Texts are equal when they are identical after deleting the white space `[\\x20\\x09-\\x0D]`. One pass over the
texts makes a table of digests; Misra-Gries counters (`freqItems`) over it name every digest that may hold more
than 1/COUNTERS of the rows. The winners of those that truly do, at most COUNTERS rows, are broadcast and
decide their rows on the map side. All other digests take an ordinary shuffle, folded before it.

Defined cases: a null text counts as empty, empty texts are equal to each other, a null id ranks after every
other id, of rows that repeat id and text one stays, no rows give no rows, and other columns of the input may
have any name.
"""

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.session import cut_lineage

WHITE = " \t\n\x0b\x0c\r"
#: Misra-Gries counters; a digest outside the broadcast holds at most this share of the rows.
COUNTERS = 256


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _digest_columns(doc_id: str, text: str) -> list[Column]:
    return [
        F.col(doc_id).alias("doc_id"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n"),
        F.sha2(normalised(F.col(text)), 256).alias("digest"),
    ]


def _best(rows: DataFrame) -> DataFrame:
    """One row per digest: size of its group and the row that stays."""
    order = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    return rows.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))


def _digests(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, digest, row), written once so that row numbers stay the same wherever they are read."""
    return cut_lineage(docs.select(*_digest_columns(doc_id, text), F.monotonically_increasing_id().alias("row")))


def _winners(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Winners of the heavy digests (at most COUNTERS rows) and of all others."""
    total = rows.count()
    named = rows.stat.freqItems(["digest"], 1 / COUNTERS).select(F.explode("digest_freqItems").alias("digest"))
    counted = _best(rows.join(F.broadcast(named), "digest", "left_semi"))
    heavy = cut_lineage(counted.filter(F.col("group_size") * COUNTERS > total))
    return heavy, _best(rows.join(F.broadcast(heavy), "digest", "left_anti"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _digests(docs, doc_id, text)
    heavy, light = _winners(rows)
    hot = rows.join(F.broadcast(heavy), "digest")
    cold = rows.join(F.broadcast(heavy), "digest", "left_anti").join(light, "digest")
    return hot.unionByName(cold).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with."""
    rows = _digests(docs, doc_id, text)
    heavy, light = _winners(rows)

    def chosen(winners: DataFrame) -> DataFrame:
        return winners.select(F.col("digest").alias("_w_digest"), F.col("best.doc_id").alias("_w_id"),
                              (-F.col("best.n")).alias("_w_n"))

    own = _digest_columns(doc_id, text)
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        own[0].alias("_id"), own[1].alias("_n"), own[2].alias("_digest"),
    )
    same = ((F.col("_digest") == F.col("_w_digest")) & F.col("_id").eqNullSafe(F.col("_w_id"))
            & (F.col("_n") == F.col("_w_n")))
    hot = marked.join(F.broadcast(chosen(heavy)), same, "left_semi")
    cold = marked.join(F.broadcast(chosen(heavy)), F.col("_digest") == F.col("_w_digest"), "left_anti").join(
        chosen(light), same, "left_semi")
    kept = hot.unionByName(cold)
    copies = rows.groupBy("digest", "doc_id", "n").count().filter("count > 1")
    if not copies.isEmpty():  # rows that repeat both id and text: one of them stays
        kept = kept.dropDuplicates(["_digest"])
    return kept.select("_doc.*")
