"""Edge producers: inheritance, contracts, mentions of names, reads, and the admission of edges. Calls: `calls`."""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from codeloom.functions.symbols import id_tail, id_whole, is_executable
from codeloom.functions.text import call_tokens, strip_comments_and_strings
from codeloom.operators.nodes import first_class_by_label
from codeloom.session import once

EDGE_KEYS = ["project_id", "source", "target", "label"]
#: block sizes of line ranges: 1 to 2**LEVELS lines
LEVELS = 31
# fixed values: order of the producers inside one source node
_RELATION_LABELS = {"extends": "EXTENDS", "implements": "IMPLEMENTS"}


def relation_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """relations(project_id, source, rel_kind, target_name) -> EXTENDS and IMPLEMENTS edges."""
    label = F.when(F.col("rel_kind") == "extends", "EXTENDS").when(F.col("rel_kind") == "implements", "IMPLEMENTS")
    wanted = relations.filter(F.col("rel_kind").isin(list(_RELATION_LABELS))).select(
        "project_id", "source", label.alias("edge_label"),
        F.trim(F.substring_index("target_name", "<", 1)).alias("label"))
    return wanted.join(first_class_by_label(nodes), ["project_id", "label"]).select(
        "project_id", "source", F.col("class_id").alias("target"), F.col("edge_label").alias("label")).distinct()


def mentions(bodies: DataFrame) -> DataFrame:
    """bodies(project_id, source, body), one per source -> (project_id, source, name) called in the cleaned text.

    The names of a body are made distinct inside its row, so the mentions need no shuffle.
    """
    return spoken(bodies).select("project_id", "source", F.explode("names").alias("name"))


def spoken(bodies: DataFrame) -> DataFrame:
    """(project_id, source, names): the mentions of a body as one row. A body is sliced once and scanned once."""
    sliced = once(bodies.select("project_id", "source", "body"), text=F.col("body")).drop("body").filter(F.col("text") != "")
    return once(sliced, names=call_tokens(strip_comments_and_strings(F.col("text")))).drop("text")


def callable_names(symbols: DataFrame) -> DataFrame:
    """(project_id, name, target) of every method and function."""
    return symbols.filter(F.col("kind").isin("method", "function")).select(
        "project_id", "name", F.col("node_id").alias("target")).distinct()


def known_mentions(mentioned: DataFrame, targets: DataFrame) -> DataFrame:
    """Mentions of names that some callable has; keywords and other words stay behind, before anything is paired."""
    return mentioned.join(targets.select("project_id", "name").distinct(), ["project_id", "name"], "left_semi")


def call_fanout(mentioned: DataFrame, symbols: DataFrame) -> DataFrame:
    """Callers and targets per name without building the pairs: what `call_edges` will cost."""
    targets = symbols.filter(F.col("kind").isin("method", "function")).groupBy("project_id", "name").agg(
        F.count("*").alias("n_targets"))
    return (
        mentioned.groupBy("project_id", "name").agg(F.count("*").alias("n_callers"))
        .join(targets, ["project_id", "name"])
    )


def _halves(ranges: DataFrame) -> DataFrame:
    """Ranges (lo, hi) as halves of the smallest aligned block of 2**level lines that holds them: columns level, block, right, at.

    Such a block is halved inside the range, so a range holds the lines of the left half from lo on and those of the
    right half up to hi; `at` is lo on the left and -hi on the right, and a range holds the lines whose own `at` is not less.
    """
    rest = [c for c in ranges.columns if c not in ("lo", "hi")]
    differ = F.col("lo").bitwiseXOR(F.col("hi"))
    level = F.when(differ == 0, 0).otherwise(F.length(F.bin(differ)))
    half = F.explode(F.array(
        F.struct(F.lit(False).alias("right"), F.col("lo").alias("at")),
        F.when(differ != 0, F.struct(F.lit(True).alias("right"), (-F.col("hi")).alias("at")))))
    return ranges.withColumn("level", level).select(
        *rest, "level", F.call_function("shiftright", F.col("lo"), F.col("level")).alias("block"), half.alias("half")
    ).filter(F.col("half").isNotNull()).select(*rest, "level", "block", "half.*")


def line_owners(callables: DataFrame, points: DataFrame) -> DataFrame:
    """First callable, in order, whose lines contain a point.

    callables(project_id, file_uri, node_id, ord, sl, el), points(project_id, file_uri, line).
    A range becomes two rows however long it is, one per half of its block, and equal halves keep their first owner; a
    point asks once for each block size that its file has, and a running minimum along the half answers it.
    """
    sl, el = F.col("sl").cast("bigint"), F.col("el").cast("bigint")
    keys = ["project_id", "file_uri"]
    half = [*keys, "level", "block", "right"]
    ranges = callables.filter((sl >= 0) & (sl <= el)).select(*keys, F.struct("ord", "node_id").alias("owner"), sl.alias("lo"), el.alias("hi"))
    pieces = _halves(ranges).groupBy(*half, "at").agg(F.min("owner").alias("owner"))
    one = F.lit(1).cast("bigint")
    levels = _halves(ranges).groupBy(*keys).agg(F.bit_or(F.call_function("shiftleft", one, "level")).alias("levels"))
    used = F.filter(F.sequence(F.lit(0), F.lit(LEVELS)),
                    lambda k: F.call_function("shiftright", F.col("levels"), k).bitwiseAND(1) == 1)
    line = F.col("line").cast("bigint")
    # the bit below the block's size tells the half; a block of one line has the left one alone
    right = F.call_function("shiftright", line * 2, F.col("level")).bitwiseAND(1) == 1
    asked = points.select(*keys, "line").distinct().join(levels, keys).select(*keys, "line", F.explode(used).alias("level"))
    asked = asked.withColumn("block", F.call_function("shiftright", line, F.col("level"))).withColumn(
        "right", (F.col("level") > 0) & right).withColumn("at", F.when(F.col("right"), -line).otherwise(line))
    along = Window.partitionBy(*half).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = pieces.unionByName(asked, allowMissingColumns=True).withColumn("owner", F.min("owner").over(along))
    return (
        met.filter(F.col("line").isNotNull() & F.col("owner").isNotNull())
        .groupBy(*keys, "line").agg(F.min("owner").alias("owner"))
        .select(*keys, "line", F.col("owner.node_id").alias("node_id"))
    )


def read_edges(refs: DataFrame, owners: DataFrame, targets: DataFrame, mentioned: DataFrame) -> DataFrame:
    """READS_FROM edges: a recorded reference inside the source, to a name the source mentions.

    refs as in the schema; owners from `line_owners`; targets(project_id, target_uri, target_line,
    target_char, target, name) are the non-callable symbols. Starts from the references, so equal
    names never meet each other. `mentioned` are the mentions, or `spoken`, whose ids move once per body.
    """
    located = refs.join(
        owners.select("project_id", F.col("file_uri").alias("ref_uri"), F.col("line").alias("ref_line"),
                      F.col("node_id").alias("source")),
        ["project_id", "ref_uri", "ref_line"])
    at = ["project_id", "target_uri", "target_line", "target_char"]
    uri = F.col("target_uri")
    ends = targets.select(*at, id_tail(F.col("target"), uri).alias("tail"), "name")
    pairs = located.select(*at, "source").distinct().join(ends, at).select(
        "project_id", "source", id_whole(F.col("tail"), uri).alias("target"), "name")
    other = pairs.filter(F.col("source") != F.col("target"))
    if "names" in mentioned.columns:
        met = other.join(mentioned, ["project_id", "source"]).filter(F.array_contains("names", F.col("name")))
    else:
        met = other.join(mentioned, ["project_id", "source", "name"], "left_semi")
    return (
        met
        .select("project_id", "source", "target", F.lit("READS_FROM").alias("label")).distinct()
    )


def executables(symbols: DataFrame) -> DataFrame:
    """Symbols whose bodies are searched for calls; an empty body drops only its own row."""
    return symbols.filter(is_executable(F.col("kind")))


def admit(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with two known, different ends, once per (source, target, label).

    Edges of unknown ends go before the others meet; these lie by source by then and need no exchange of their own.
    """
    ids = nodes.select("project_id", "node_id")
    return (
        edges.filter((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")))
        .join(ids.withColumnRenamed("node_id", "target"), ["project_id", "target"], "left_semi")
        .join(ids.withColumnRenamed("node_id", "source"), ["project_id", "source"], "left_semi")
        .dropDuplicates(EDGE_KEYS)
    )


def union_edges(parts: list[DataFrame]) -> DataFrame:
    """Union of producers that take both ends from the node table, with a stable id.

    Each producer gives distinct rows under labels of its own, so only self loops are left to drop
    and the edges, the largest table, need no shuffle here. Edges from elsewhere go through `admit`.
    """
    every = reduce(DataFrame.unionByName, [p.select(*EDGE_KEYS) for p in parts])
    return every.filter(F.col("source") != F.col("target")).withColumn("edge_id", edge_id())


def edge_id():
    return F.xxhash64(*EDGE_KEYS)
