"""The whole analysis as lazy plans: tables in, graph tables out."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from codeloom.functions.signatures import is_field, lowered_relations, relation_rows
from codeloom.functions.symbols import id_tail, id_whole, kind_name
from codeloom.operators import (
    calls as C, checks, edges as E, enrich as R, graph as G, nodes as N, packages as P, relations, semantics, views as V)
from codeloom.session import release, written
from codeloom.sources.packages import uri_path
from codeloom.sources.symbols import TOLD, told


@dataclass
class CodeGraph:
    """`few` are the edges that are no calls, `calls` the calls in two halves; views read these.

    Only `edges` pairs every caller with every target of a called name.
    """

    symbols: DataFrame
    nodes: DataFrame
    few: DataFrame
    calls: C.Calls
    bodies: DataFrame
    sources: DataFrame
    types: DataFrame
    params: DataFrame
    returns: DataFrame
    violations: DataFrame
    profiles: DataFrame
    imports: DataFrame
    files: DataFrame

    @property
    def edges(self) -> DataFrame:
        return self.few.unionByName(E.union_edges([C.pairs(self.calls)]))

    def breakdown(self) -> DataFrame:
        """Edges per project and label."""
        calls = C.totals(self.calls).select("project_id", F.lit(C.LABEL).alias("label"), "n_edges")
        return G.edge_breakdown(self.few).unionByName(calls)

    def totals(self) -> DataFrame:
        """Nodes, containers and edges per project."""
        return G.sized(self.nodes, G.edge_counts(self.few).unionByName(C.totals(self.calls)))

    def folder_edges(self) -> DataFrame:
        """Edges between folders and between features; nodes of no file of the project have neither."""
        rel = F.coalesce("rel_path", F.lit(""))
        placed = self.nodes.select("project_id", "file_uri", "node_id").join(
            self.files.select("project_id", "file_uri", "rel_path"), ["project_id", "file_uri"], "left").select(
            "project_id", "node_id", V.feature_of(rel).alias("feature"), V.folder_of(rel).alias("folder"))
        at = written(V.places(placed))
        return V.lifted(V.folder_pairs(self.few, at).unionByName(C.folder_pairs(self.calls, at)))

    def neighbourhood(self, focus: DataFrame) -> DataFrame:
        """Members, predecessors and successors of focus(project_id, node_id)."""
        return G.neighbourhood(self.nodes, self.few, focus, self.calls)

    def verb_groups(self) -> DataFrame:
        """Per node and verb: label class, number of partners, first partner."""
        return relations.graph_verb_groups(self.few, self.calls, self.nodes)


def layered(symbols: DataFrame) -> DataFrame:
    """Enriched and marked symbols with their architectural layer; none for those without a kind."""
    keyed = symbols.withColumns({
        "key": F.col("node_id"), "parent_key": F.col("parent_node_id"),
        "bases": lowered_relations(F.col("relations")),
    })
    known = N.with_layers(keyed, keyed.filter("own"))
    return known.unionByName(keyed.filter("kind IS NULL"), allowMissingColumns=True).drop("key", "parent_key", "bases")


def type_references(symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Declared types with their definitions: of fields, of parameters, and of returned values."""
    definitions = R.type_definitions(symbols)
    keys = ["project_id", "symbol_uid", "node_id"]

    def uses(rows: DataFrame, shown: str) -> DataFrame:
        return R.resolve_types(rows.filter(F.col(shown).isNotNull()).select(*keys, F.col(shown).alias("type")), definitions, "type", "ref")

    own = R.resolve_own_fields(R.param_rows(symbols), symbols)
    return (uses(symbols.filter(is_field(F.col("kind"))), "resolved_type"), R.resolve_types(own, definitions, "type", "ref"),
            uses(symbols, "return_type"))


def build_graph(symbols: DataFrame, files: DataFrame, hovers: DataFrame, refs: DataFrame, packages: DataFrame,
                keep_symbols: bool = True) -> CodeGraph:
    """symbols come from `flatten_trees`, whose tables go as soon as they are read unless kept; the other tables follow the schemas."""
    # enriched symbols, nodes and what edges are read from are one table, written without the ids, which are made when it is read
    evidence = written(R.enrich(symbols, files, hovers).drop(*TOLD))
    if not keep_symbols:
        release(symbols)
    stored = written(layered(N.marked(told(evidence))).drop(*TOLD))
    release(evidence)
    marks = ["own", "first", "last"]
    enriched = told(stored.filter("own")).drop(*marks)
    known = enriched.filter("kind IS NOT NULL")
    # first symbol makes the node, last symbol is what edges are read from
    nodes = N.node_rows(told(stored.filter("first")))
    current = told(stored.filter("last")).select(
        "project_id", "node_id", "ord", "file_uri", "name", "kind", "rng", "sel_rng", "relations")
    bodies = R.slice_bodies(
        E.executables(current).select("project_id", "file_uri", "node_id", "kind", "rng", "sel_rng"), files)
    # calls and reads both ask for the mentions; the bodies behind them are sliced and scanned once
    spoken = written(E.spoken(bodies.select("project_id", F.col("node_id").alias("source"), "body")))
    declared = current.select(
        "project_id", F.col("node_id").alias("source"), F.explode(relation_rows(F.col("relations"))).alias("r"),
    ).select("project_id", "source", "r.*")
    named = current.select("project_id", "node_id", "name", kind_name(F.col("kind")).alias("kind"))
    callables = nodes.filter(F.col("kind").isin("method", "function") & F.col("rng").isNotNull()).select(
        "project_id", "file_uri", id_tail(F.col("node_id"), F.col("file_uri")).alias("node_id"), F.col("ord.sym_path").alias("ord"),
        F.col("rng.sl").alias("sl"), F.col("rng.el").alias("el"))
    # one file's symbols meet here, so their order and ids move without its uri
    owners = written(E.line_owners(callables, refs.select(
        "project_id", F.col("ref_uri").alias("file_uri"), F.col("ref_line").alias("line"))).withColumn(
        "node_id", id_whole(F.col("node_id"), F.col("file_uri"))))
    passive = current.filter(~F.col("kind").isin(6, 12) & F.col("sel_rng").isNotNull()).select(
        "project_id", F.col("file_uri").alias("target_uri"), F.col("sel_rng.sl").alias("target_line"),
        F.col("sel_rng.sc").alias("target_char"), F.col("node_id").alias("target"), "name")
    sources = P.file_sources(
        files.select("project_id", "file_uri", uri_path(F.col("file_uri")).alias("path")), packages)
    every = P.assign_containers(nodes, sources).unionByName(P.container_nodes(packages), allowMissingColumns=True)
    # the edges that are no calls are few; they and the package edges of all calls are kept, each written by a step of
    # its own, whose exchange files go before the next one begins
    plain = [written(E.union_edges([part])) for part in (
        E.relation_edges(declared, nodes), E.read_edges(refs, owners, passive, spoken))]
    plain = plain[0].unionByName(plain[1])
    release(owners)
    packaged = written(every.select("project_id", "node_id", F.col("source.package_name").alias("package")))
    calls = C.halves(spoken.select("project_id", "source", F.explode("names").alias("name")), named)
    calls = C.Calls(written(calls.callers), written(calls.targets))
    release(spoken)
    between = written(P.package_edges(plain, packaged)).unionByName(written(C.package_edges(calls, packaged))).distinct()
    release(packaged)
    few = plain.unionByName(written(E.union_edges([between])))
    counts = G.degree_counts(few).unionByName(C.degrees(calls)).groupBy("project_id", "node_id").agg(
        F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))
    types, params, returns = type_references(enriched)
    return CodeGraph(
        known, G.with_counts(every, counts), few, calls, bodies, sources, types, params, returns, checks.violations(enriched),
        semantics.semantic_profile(bodies.withColumn("kind", kind_name(F.col("kind")))),
        V.node_imports(nodes, V.file_imports(files)), files)
