"""Overview queries on a finished graph."""

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions.text import package_imports


def layer_overview(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("layer") != "member").groupBy("project_id", "layer").agg(F.count("*").alias("n_components"))


def search_layer(nodes: DataFrame, layer: str, text: str) -> DataFrame:
    return nodes.filter((F.col("layer") == layer) & F.lower("label").contains(text.lower()))


def folder_of(rel_path: Column) -> Column:
    return F.when(rel_path.contains("/"), F.regexp_replace(rel_path, r"/[^/]*\z", "")).otherwise(F.lit(""))


def feature_of(rel_path: Column) -> Column:
    """First directory, or the first one below lib."""
    below = F.regexp_replace(rel_path, r"^lib/", "")
    return F.when(below.contains("/"), F.substring_index(below, "/", 1)).otherwise(F.lit(""))


def folder_rollup(nodes: DataFrame) -> DataFrame:
    """Node counts at folder, feature, project and lake level; nodes needs feature and folder.

    The specific level is the node table itself, so it is not expanded here.
    """
    return nodes.rollup("project_id", "feature", "folder").agg(
        F.count("*").alias("n_nodes"), F.grouping_id().cast("int").alias("level"))


def folder_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project_id, source_at, target_at, n): edges between places; nodes(project_id, node_id, at)."""
    def end(side: str) -> DataFrame:
        return nodes.select("project_id", F.col("node_id").alias(side), F.col("at").alias(f"{side}_at"))
    joined = edges.select("project_id", "source", "target") \
        .join(end("source"), ["project_id", "source"]).join(end("target"), ["project_id", "target"])
    return joined.groupBy("project_id", "source_at", "target_at").agg(F.count("*").alias("n"))


def places(nodes: DataFrame) -> DataFrame:
    """(project_id, node_id, at): the feature and folder of every node."""
    return nodes.select("project_id", "node_id", F.struct(F.col("feature"), F.col("folder")).alias("at"))


def lifted(pairs: DataFrame) -> DataFrame:
    """Folder pairs as edges between different folders and different features, with their numbers."""
    rows = pairs.select("project_id", "n", F.explode(F.array(
        F.struct(F.lit("folder").alias("level"), F.col("source_at.folder").alias("source"), F.col("target_at.folder").alias("target")),
        F.struct(F.lit("feature").alias("level"), F.col("source_at.feature").alias("source"), F.col("target_at.feature").alias("target")),
    )).alias("e")).select("project_id", "n", "e.*")
    return rows.filter(F.col("source") != F.col("target")).groupBy("project_id", "level", "source", "target").agg(
        F.sum("n").alias("n_edges"))


def lifted_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between different folders and different features, with their numbers.

    Folded to folder pairs first: the other level is a second, much smaller fold.
    """
    return lifted(folder_pairs(edges, places(nodes)))


def members_per_component(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("parent").isNotNull()).groupBy("project_id", F.col("parent").alias("node_id")).agg(
        F.count("*").alias("n_members"))


def package_overview(packages: DataFrame) -> DataFrame:
    """Developed and consumed packages of each project."""
    group = F.when(F.col("type") == "custom", "developed").otherwise("consumed")
    return packages.groupBy("project_id", group.alias("package_group")).agg(F.count("*").alias("n_packages"))


def provenance_counts(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") != "package_container").groupBy(
        "project_id", F.col("source.type").alias("source_type")).agg(F.count("*").alias("n_nodes"))


def focus_nodes(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """First node, in order, whose label or id is the requested text; requests(project_id, request)."""
    wanted = requests.select("project_id", "request").distinct()
    keyed = nodes.select("project_id", "node_id", "ord", F.explode(
        F.array_distinct(F.array("label", "node_id"))).alias("request"))
    return keyed.join(wanted, ["project_id", "request"], "left_semi").groupBy("project_id", "request").agg(
        F.min_by("node_id", F.struct("ord", "node_id")).alias("node_id"))


def file_imports(files: DataFrame) -> DataFrame:
    return files.select("project_id", "file_uri", F.explode(package_imports(F.col("content"))).alias("package"))


def node_imports(nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """Imports of the file each node lives in."""
    return nodes.select("project_id", "node_id", "file_uri").join(imports, ["project_id", "file_uri"]).select(
        "project_id", "node_id", "package")
