"""Whole-graph operators: degrees, label counts, data-flow traces, neighbourhoods."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.operators import calls as C
from codeloom.schemas import FLOW_HOPS
from codeloom.session import written


def degree_counts(edges: DataFrame) -> DataFrame:
    """(project_id, node_id, in_degree, out_degree) of all edge ends.

    Both counts come from one pass over the edges and one aggregate, folded before the shuffle.
    """
    def end(side: str, coming: int):
        return F.struct(F.col(side).alias("node_id"), F.lit(coming).alias("coming"), F.lit(1 - coming).alias("leaving"))
    return (
        edges.select("project_id", F.explode(F.array(end("source", 0), end("target", 1))).alias("e"))
        .groupBy("project_id", "e.node_id").agg(
            F.sum("e.coming").alias("in_degree"), F.sum("e.leaving").alias("out_degree"))
    )


def with_counts(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    return nodes.join(counts, ["project_id", "node_id"], "left").fillna(0, ["in_degree", "out_degree"])


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Add in_degree and out_degree; edge ends that are not nodes count for nobody."""
    return with_counts(nodes, degree_counts(edges))


def degree_ranks(counted: DataFrame) -> DataFrame:
    """Add degree and its rank within the project, equal degrees sharing one.

    Nodes are first folded to one row per degree, so the running count goes over few rows, not over all nodes.
    """
    rows = counted.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    above = Window.partitionBy("project_id").orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = rows.groupBy("project_id", "degree").agg(F.count("*").alias("_n")).withColumn(
        "rank", F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).drop("_n")
    return rows.join(ranks, ["project_id", "degree"])


def edge_breakdown(edges: DataFrame) -> DataFrame:
    return edges.groupBy("project_id", "label").agg(F.count("*").alias("n_edges"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("project_id").agg(F.count("*").alias("n_edges"))


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return sized(nodes, edge_counts(edges))


def sized(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """Nodes, containers and edges per project; counts(project_id, n_edges) may hold several rows of a project."""
    n = nodes.groupBy("project_id").agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("kind") == "package_container").alias("n_containers"))
    e = counts.groupBy("project_id").agg(F.sum("n_edges").alias("n_edges"))
    return n.join(e, "project_id", "left").fillna(0, ["n_edges"])


def flow_links(edges: DataFrame, hops: int = FLOW_HOPS) -> DataFrame:
    """(project_id, back, at, links): ordered neighbours of every node, as many as a trace can ever look at.

    Backwards a trace goes from the target of a WRITES_TO edge to its source, otherwise from the source of a READS_FROM
    edge to its target; both come from one pass over the edges. A trace holds at most 2 * hops + 1 nodes, its end among
    them, so its first unseen neighbour is among the first 2 * hops + 2 distinct ones; nothing beyond them can be chosen.
    """
    back = F.col("label") == "WRITES_TO"
    ends = edges.filter(F.col("label").isin("WRITES_TO", "READS_FROM")).select(
        "project_id", back.alias("back"), F.when(back, F.col("target")).otherwise(F.col("source")).alias("at"),
        F.when(back, F.col("source")).otherwise(F.col("target")).alias("to"), "edge_ord")
    first = ends.groupBy("project_id", "back", "at", "to").agg(F.min("edge_ord").alias("ord"))
    w = Window.partitionBy("project_id", "back", "at").orderBy("ord", "to")
    return (
        first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 2 * hops + 2)
        .groupBy("project_id", "back", "at").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "to"))), lambda x: x["to"]).alias("links"))
    )


def trace_flow(edges: DataFrame, starts: DataFrame, hops: int = FLOW_HOPS) -> DataFrame:
    """Greedy trace of every start at once: writers backwards, then readers forwards.

    edges(project_id, edge_ord, source, target, label), starts(project_id, start) ->
    (project_id, start, path, complete); `complete` is false where `hops` ended a walk that could go on.
    """
    links = written(flow_links(edges, hops))
    traces = starts.select("project_id", "start", F.array("start").alias("path"), F.lit(True).alias("complete"))
    traces = _walk(traces, links.filter("back").drop("back"), hops, lambda path, nxt: F.concat(F.array(nxt), path))
    return _walk(traces, links.filter("NOT back").drop("back"), hops, lambda path, nxt: F.concat(path, F.array(nxt)))


def _walk(traces: DataFrame, links: DataFrame, hops: int, grow) -> DataFrame:
    """One direction. Traces whose start has no link, most of them in a code graph, take no part in the hops.

    Each hop is one equi-join of the moving traces with the link table. The whole direction is one plan, so all its
    joins share one exchange of the links, and a crowded node is split over tasks by the adaptive skew join.
    """
    cols = ["project_id", "start", "path", "complete"]
    state = written(traces.select(*cols))
    able = links.select("project_id", F.col("at").alias("start"))
    resting = state.join(able, ["project_id", "start"], "left_anti")
    # a finished trace asks for a node that cannot exist, different for each, so none pile up
    nowhere = F.concat(F.lit("\u0000"), F.col("start"))
    moving = state.join(able, ["project_id", "start"], "left_semi").withColumn("at", F.col("start"))
    unseen: Column = F.get(F.filter("links", lambda n: ~F.array_contains(F.col("path"), n)), F.lit(0))
    for _ in range(hops):
        moving = (
            moving.join(links, ["project_id", "at"], "left").withColumn("nxt", unseen)
            .select("project_id", "start",
                    F.when(F.col("nxt").isNull(), F.col("path")).otherwise(grow(F.col("path"), F.col("nxt"))).alias("path"),
                    "complete", F.coalesce("nxt", nowhere).alias("at"))
        )
    # walks that are still open look once more: is there anywhere left to go?
    more = F.exists("links", lambda n: ~F.array_contains(F.col("path"), n))
    ended = moving.join(links, ["project_id", "at"], "left").withColumn(
        "complete", F.col("complete") & ~F.coalesce(more, F.lit(False)))
    return resting.unionByName(ended.select(*cols))


def neighbourhood(nodes: DataFrame, edges: DataFrame, focus: DataFrame, calls: C.Calls | None = None) -> DataFrame:
    """Members, predecessors and successors of every focus(project_id, node_id), one row each.

    `calls` adds the calls by their halves, where `edges` leaves them out.
    """
    f = focus.select("project_id", F.col("node_id").alias("focus")).distinct()

    def near(rows: DataFrame, mine: str, role: str, other: str) -> DataFrame:
        ends = rows.select("project_id", F.col(mine).alias("focus"), F.lit(role).alias("role"), F.col(other).alias("other"))
        return ends.join(f, ["project_id", "focus"], "left_semi").select("project_id", "focus", "role", "other").distinct()

    def around(rows: DataFrame) -> list[DataFrame]:
        return [near(rows, "target", "predecessor", "source"), near(rows, "source", "successor", "target")]
    # roles share no row, so each is made distinct where it met the focus; edges of two known ends are the same
    # rows for both roles and share their exchange
    whole = F.col("source").isNotNull() & F.col("target").isNotNull()
    every = reduce(DataFrame.unionByName, [
        near(nodes, "parent", "member", "node_id"), *around(edges.filter(whole)), *around(edges.filter(~whole))])
    return every if calls is None else every.unionByName(C.around(calls, f)).distinct()


def package_uses(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Imported packages of a node's file split into the project's own and external ones.

    imports(project_id, node_id, package); packages(project_id, name, type).
    """
    types = packages.select("project_id", F.col("name").alias("package"), "type").dropDuplicates(["project_id", "package"])
    role = F.when(F.col("type") == "custom", "own_import").otherwise("external_import")
    return imports.join(types, ["project_id", "package"], "left").select(
        "project_id", "node_id", "package", role.alias("role"))
