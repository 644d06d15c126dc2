"""Mixing sources to target weights by iterative proportional fitting (native).

Token counts are folded to cells (source, language, topic). Every dimension is folded to the values its target
lists and `other`, so there are at most prod(len(target) + 1) cells whatever the corpus holds; that bound is
checked before anything runs. Raking scales the cells to the source, language and topic targets in turn,
SWEEPS times; with all cells in one partition each step is a window over at most that many rows and no
shuffle. Calibrated weights become inclusion probabilities for a token budget: where a cell would have to give
more than it has it gives all, and the rest is dealt out again in proportion. A document is drawn when a hash of
its id falls below its cell's probability, so a draw doesn't depend on partitions or on other documents.

Defined cases: a null source, language or text counts as unlisted or empty; target values without any tokens
are left out and the others rescaled; documents without words carry no weight and are drawn at their cell's
probability; rows that repeat an id are drawn alike; an empty table gives an empty one.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.session import cut_lineage

OTHER = "other"
SWEEPS = 12
#: sweeps in one plan
CUT_EVERY = 8
MAX_CELLS = 20_000
BUDGET = 0.6
SEED = "mix-1"
#: shares by value; `other` takes every value that is not listed
SOURCES = {**{f"src{i}": 0.045 for i in range(20)}, OTHER: 0.10}
LANGS = {"en": 0.50, "de": 0.17, "fr": 0.17, "es": 0.11, OTHER: 0.05}
TOPICS = {"short": 0.05, "article": 0.55, "long": 0.30, OTHER: 0.10}
DIMENSIONS = ("source", "lang", "topic")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def default_topic(text: Column, n_tokens: Column) -> Column:
    """A topic that needs no model: symbol-heavy pages, then classes of length."""
    chars = F.char_length(text)
    symbols = chars - F.char_length(F.translate(text, "|$%&#*!<>{}=", ""))
    return (F.when(symbols * 20 > chars, OTHER).when(n_tokens < 100, "short").when(n_tokens < 800, "article")
            .otherwise("long"))


def _listed(value: Column, target: dict[str, float]) -> Column:
    return F.when(value.isin([v for v in target if v != OTHER]), value).otherwise(F.lit(OTHER))


def _share(value: Column, target: dict[str, float]) -> Column:
    cases = reduce(lambda c, kv: c.when(value == kv[0], F.lit(float(kv[1]))), target.items(), F)
    return cases.otherwise(F.lit(0.0))


def tagged(docs: DataFrame, targets: dict[str, dict[str, float]], text: str, topic: str | None) -> DataFrame:
    """The documents as `_doc` with their cell and token count."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
                       body.alias("_body"), word_count(F.col(text)).alias("n_tokens"))
    kind = F.col(f"_doc.`{topic}`") if topic else default_topic(F.col("_body"), F.col("n_tokens"))
    return rows.select(
        "_doc", "n_tokens", _listed(F.col("_doc.source"), targets["source"]).alias("source"),
        _listed(F.col("_doc.lang"), targets["lang"]).alias("lang"), _listed(kind, targets["topic"]).alias("topic"))


def calibrate(cells: DataFrame, targets: dict[str, dict[str, float]], budget: float, sweeps: int) -> DataFrame:
    """(source, lang, topic, tokens) -> the same with `weight`, the raked share, and `probability`."""
    bound = 1
    for d in DIMENSIONS:
        bound *= len({*targets[d], OTHER})
    if bound > MAX_CELLS:
        raise ValueError(f"{bound} cells; at most {MAX_CELLS} are raked in one partition")
    every = W.partitionBy()
    rows = cells.filter("tokens > 0").repartition(1)
    rows = rows.withColumn("total", F.sum("tokens").over(every)).withColumn("w", F.col("tokens") / F.col("total"))
    for d in DIMENSIONS:  # a target without tokens can't be met; the others share its part
        first = F.row_number().over(W.partitionBy(d).orderBy(*DIMENSIONS)) == 1
        rows = rows.withColumn(f"t_{d}", _share(F.col(d), targets[d])).withColumn("_first", first)
        rows = rows.withColumn(f"t_{d}", F.col(f"t_{d}") / F.sum(F.when(F.col("_first"), F.col(f"t_{d}"))).over(every))
        rows = rows.drop("_first")
    for k in range(sweeps):
        if k and k % CUT_EVERY == 0:
            rows = cut_lineage(rows).coalesce(1)
        for d in DIMENSIONS:
            held = F.sum("w").over(W.partitionBy(d))
            rows = rows.withColumn("w", F.when(held > 0, F.col("w") * F.col(f"t_{d}") / held).otherwise(0.0))
    # water-filling: cells in the order in which they run out; each that runs out gives all it has
    rows = rows.withColumn("need", F.when(F.col("w") > 0, F.col("tokens") / F.col("w")))
    order = W.orderBy(F.col("need").asc_nulls_last(), *DIMENSIONS)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("given", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    rows = rows.withColumn("open", F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    rows = rows.withColumn("scale", F.when(F.col("open") > 0,
                                           (F.lit(float(budget)) * F.col("total") - F.col("given")) / F.col("open")))
    rows = rows.withColumn("runs_out", F.col("scale") >= F.col("need"))
    scale = F.min(F.when(~F.col("runs_out"), F.struct("need", *DIMENSIONS, "scale"))).over(every)["scale"]
    rows = rows.withColumn("level", scale)
    drawn = F.when(F.col("w") <= 0, 0.0).when(F.col("runs_out") | F.col("level").isNull(), 1.0).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("level") * F.col("w") / F.col("tokens"))))
    return rows.select(*DIMENSIONS, "tokens", F.col("w").alias("weight"), drawn.alias("probability"))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixture(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, *, budget: float = BUDGET,
            seed: str = SEED, sweeps: int = SWEEPS, doc_id: str = "doc_id", text: str = "text",
            topic: str | None = None) -> DataFrame:
    """Every document as `_doc` with n_tokens, its cell, probability, and whether it was drawn."""
    targets = targets or {"source": SOURCES, "lang": LANGS, "topic": TOPICS}
    rows = tagged(docs, targets, text, topic)
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    # at most MAX_CELLS rows
    found = F.broadcast(calibrate(cells, targets, budget, sweeps).select(*DIMENSIONS, "probability"))
    out = rows.join(found, list(DIMENSIONS), "left")
    out = out.withColumn("probability", F.round(F.coalesce("probability", F.lit(0.0)), 9))
    return out.withColumn("sampled", draw(F.col(f"_doc.`{doc_id}`"), seed) < F.col("probability"))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The drawn documents, with the columns they came with."""
    return mixture(docs, **options).filter("sampled").select("_doc.*")
