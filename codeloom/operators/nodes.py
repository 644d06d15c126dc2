"""Symbols to graph nodes: member features, layers, first-wins identity."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions.layers import PLAIN_METHODS, layer
from codeloom.functions.symbols import access, is_sdk_uri, kind_name
from codeloom.schemas import KIND_CLASS, KIND_ENUM, KIND_METHOD
from codeloom.session import written

FEATURES = [
    "fields", "methods", "build_methods", "event_methods", "state_fields", "async_methods",
    "business_methods",
]
NODE_COLS = [
    "project_id", "node_id", "ord", "label", "kind", "file_uri", "rng", "sel_rng", "access", "is_sdk",
    "layer", "parent",
]


def member_features(symbols: DataFrame) -> DataFrame:
    """One row per container: counts of the member shapes the layer rules ask for.

    symbols needs project_id, parent_key, name, kind, detail, return_type.
    """
    name = F.col("name")
    field = F.col("kind").isin(7, 8)
    method = F.col("kind") == KIND_METHOD
    returns = F.coalesce(F.lower("return_type"), F.lit(""))
    slow = returns.contains("future") | returns.contains("stream") | F.lower(name).contains("async")
    # fixed values: the member names that the layer rules count
    rules = {
        "fields": field,
        "methods": method,
        "build_methods": method & (name == "build"),
        "event_methods": method & name.isin("add", "emit", "on"),
        "state_fields": field & name.isin("stream", "state"),
        "async_methods": method & slow,
        "business_methods": method & ~F.lower(name).isin(PLAIN_METHODS),
    }
    return (
        symbols.filter(F.col("parent_key").isNotNull())
        .groupBy("project_id", "parent_key").agg(*[F.count_if(cond).alias(n) for n, cond in rules.items()])
    )


def with_layers(symbols: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Add `layer`. symbols needs project_id, key, parent_key, name, kind, detail, return_type, bases; so do `members`, which count instead of them."""
    feats = member_features(symbols if members is None else members).select(
        "project_id", F.col("parent_key").alias("key"), F.struct(*FEATURES).alias("feats"))
    none = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in FEATURES])
    bases = F.coalesce("bases", F.array().cast("array<string>"))
    typed = F.col("kind").isin(KIND_CLASS, KIND_ENUM)
    # only classes and enums need the counts; members skip the join
    types = symbols.filter(typed).join(feats, ["project_id", "key"], "left").withColumn(
        "layer", layer(F.col("name"), F.col("kind"), bases, F.coalesce("feats", none))).drop("feats")
    return types.unionByName(symbols.filter(~typed).withColumn("layer", F.lit("member")))


def node_rows(symbols: DataFrame) -> DataFrame:
    """Project symbols to node columns; expects layer to be there."""
    sdk = F.coalesce("is_sdk", F.lit(False)) if "is_sdk" in symbols.columns else is_sdk_uri(F.col("file_uri"))
    return symbols.select(
        "project_id", "node_id", "ord", F.col("name").alias("label"), kind_name(F.col("kind")).alias("kind"),
        "file_uri", "rng", "sel_rng", access(F.col("name")).alias("access"), sdk.alias("is_sdk"),
        "layer", F.col("parent_node_id").alias("parent"),
    )


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the first row per key; an aggregate, so repeats are folded before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return _pick(rows, keys, F.min_by(F.struct(*rest), F.col(order)), rest)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return _pick(rows, keys, F.max_by(F.struct(*rest), F.col(order)), rest)


def marked(symbols: DataFrame) -> DataFrame:
    """Add `own`, `first` and `last`: rows that are symbols, that make a node and that its edges are read from.

    A symbol whose id comes once is all three. Of other ids the winners come once more, as rows that are not `own`.
    Which ids these are is asked by their hashes, so the others don't move; a symbol without a kind makes no node.
    """
    def flagged(rows: DataFrame, *flags: str) -> DataFrame:
        return rows.withColumns({flag: F.lit(flag in flags) for flag in ("own", "first", "last")})

    code, keys, kind = F.xxhash64("project_id", "node_id"), ["project_id", "node_id"], F.col("kind")
    twice = written(symbols.groupBy(code.alias("_code")).agg(F.count("*").alias("n")).filter("n > 1").select("_code"))
    coded = symbols.withColumn("_code", code)
    once = flagged(coded.join(twice, "_code", "left_anti").drop("_code"), "own", "first", "last").withColumn("first", kind.isNotNull())
    several = coded.join(twice, "_code", "left_semi").drop("_code")
    parts = [once, flagged(several, "own"), flagged(first_wins(several.filter(kind.isNotNull()), keys, "ord"), "first"),
             flagged(last_wins(several, keys, "ord"), "last")]
    return reduce(DataFrame.unionByName, parts)


def _pick(rows: DataFrame, keys: list[str], chosen: Column, rest: list[str]) -> DataFrame:
    picked = rows.groupBy(*keys).agg(chosen.alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*rows.columns)


def first_class_by_label(nodes: DataFrame) -> DataFrame:
    """The dimension name lookups use: first class node of every label."""
    return (
        nodes.filter(F.col("kind") == "class")
        .groupBy("project_id", "label").agg(F.min_by("node_id", "ord").alias("class_id"))
    )


def index_entries(symbols: DataFrame) -> DataFrame:
    """(project_id, name, node_id, first): every id that a name stands for, and its first place. Rows, not lists."""
    return symbols.groupBy("project_id", "name", "node_id").agg(F.min("ord").alias("first"))


def name_index(symbols: DataFrame) -> DataFrame:
    """How many symbols carry a name, and the first of them; `index_entries` has them all."""
    return symbols.groupBy("project_id", "name").agg(
        F.count("*").alias("n_symbols"), F.min_by("node_id", "ord").alias("first_id"))
