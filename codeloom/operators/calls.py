"""Calls in two halves: (caller, name) and (name, target).

Every method or function of a called name is a target, so the edge table has callers x targets rows per name. All
that a view asks of the calls is computed here from the halves, folded per name first; only `pairs` builds the edges.
An id holds one name, so no pair of caller and target comes twice; a symbol that names itself is no call.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from codeloom.functions.verbs import label_class, smart_verb
from codeloom.operators import edges as E, packages as P

NAMES = ["project_id", "name"]
LABEL = "CALLS"


@dataclass
class Calls:
    """callers(project_id, name, source) and targets(project_id, name, target), distinct; callers only of known names."""

    callers: DataFrame
    targets: DataFrame


def halves(mentioned: DataFrame, symbols: DataFrame) -> Calls:
    """mentioned(project_id, source, name), symbols(project_id, node_id, name, kind name)."""
    targets = E.callable_names(symbols).select(*NAMES, "target")
    return Calls(E.known_mentions(mentioned, targets).select(*NAMES, "source"), targets)


def pairs(calls: Calls) -> DataFrame:
    """The CALLS edges themselves."""
    return calls.callers.join(calls.targets, NAMES).filter(F.col("source") != F.col("target")).select(
        "project_id", "source", "target", F.lit(LABEL).alias("label"))


def _own(calls: Calls) -> DataFrame:
    """Symbols that name themselves."""
    return calls.callers.join(calls.targets.withColumnRenamed("target", "source"), [*NAMES, "source"], "left_semi")


def _per_name(half: DataFrame, out: str) -> DataFrame:
    return half.groupBy(*NAMES).agg(F.count("*").alias(out))


def totals(calls: Calls) -> DataFrame:
    """(project_id, n_edges): how many CALLS edges a project has; none for projects without."""
    per_name = _per_name(calls.callers, "a").join(_per_name(calls.targets, "b"), NAMES)
    counted = per_name.select("project_id", (F.col("a") * F.col("b")).alias("n")).unionByName(
        _own(calls).select("project_id", F.lit(-1).cast("bigint").alias("n")))
    return counted.groupBy("project_id").agg(F.sum("n").alias("n_edges")).filter("n_edges > 0")


def degrees(calls: Calls) -> DataFrame:
    """(project_id, node_id, in_degree, out_degree) of the CALLS edges."""
    def node(rows: DataFrame, column: str, **counts) -> DataFrame:
        return rows.select("project_id", F.col(column).alias("node_id"), *[v.cast("bigint").alias(k) for k, v in counts.items()])
    zero, one = F.lit(0), F.lit(-1)
    parts = [
        node(calls.targets.join(_per_name(calls.callers, "n"), NAMES), "target", coming=F.col("n"), leaving=zero),
        node(calls.callers.join(_per_name(calls.targets, "n"), NAMES), "source", coming=zero, leaving=F.col("n")),
        node(_own(calls), "source", coming=one, leaving=one)]
    return reduce(DataFrame.unionByName, parts).groupBy("project_id", "node_id").agg(
        F.sum("coming").alias("in_degree"), F.sum("leaving").alias("out_degree")).filter("in_degree > 0 OR out_degree > 0")


def package_edges(calls: Calls, node_packages: DataFrame) -> DataFrame:
    return P.call_package_edges(calls.callers, calls.targets, node_packages)


def folder_pairs(calls: Calls, nodes: DataFrame) -> DataFrame:
    """(project_id, source_at, target_at, n): calls between places; nodes(project_id, node_id, at).

    Both halves are folded to places per name, so a name meets as many rows as it has places, not symbols. Calls of
    a symbol to itself stay inside one place; they are counted there and left out by the views.
    """
    def places(half: DataFrame, side: str) -> DataFrame:
        at = nodes.select("project_id", F.col("node_id").alias(side), F.col("at").alias(f"{side}_at"))
        return half.join(at, ["project_id", side]).groupBy(*NAMES, f"{side}_at").agg(F.count("*").alias(f"{side}_n"))
    met = places(calls.callers, "source").join(places(calls.targets, "target"), NAMES)
    return met.groupBy("project_id", "source_at", "target_at").agg(F.sum(F.col("source_n") * F.col("target_n")).alias("n"))


def around(calls: Calls, focus: DataFrame) -> DataFrame:
    """(project_id, focus, role, other): who the focus symbols call and who calls them; focus(project_id, focus).

    Only the names of the focus symbols are paired, so the rows are those of the answer.
    """
    def seen(mine: DataFrame, side: str, others: DataFrame, other: str, role: str) -> DataFrame:
        asked = mine.withColumnRenamed(side, "focus").join(focus, ["project_id", "focus"], "left_semi")
        return asked.join(others.withColumnRenamed(other, "other"), NAMES).filter(F.col("focus") != F.col("other")).select(
            "project_id", "focus", F.lit(role).alias("role"), "other")
    return seen(calls.callers, "source", calls.targets, "target", "successor").unionByName(
        seen(calls.targets, "target", calls.callers, "source", "predecessor"))


def relation_groups(calls: Calls, nodes: DataFrame) -> DataFrame:
    """Parts of `verb_groups` for the calls: what each focus says of all its callers or targets of one name.

    nodes(project_id, node_id, label, layer). Rows: project_id, focus, focus_label, verb, label_class, n_partners and
    first, the least (label, partner, partner_label). A verb asks for both layers and the target's label, which is the
    called name, so partners are folded per (name, layer) before they meet a focus.
    """
    ends = nodes.select("project_id", "node_id", "label", "layer")

    def known(half: DataFrame, side: str) -> DataFrame:
        return half.join(ends.select("project_id", F.col("node_id").alias(side), F.col("label").alias(f"{side}_label"),
                                     F.col("layer").alias(f"{side}_layer")), ["project_id", side])
    # partners with the focus's own label are dropped; a target's label is the name
    callers = known(calls.callers, "source").filter(F.col("source_label") != F.col("name"))
    targets = known(calls.targets, "target")
    verb = smart_verb(label_class(F.lit(LABEL)), F.col("source_layer"), F.col("target_layer"), F.col("name"))

    def told(mine: DataFrame, side: str, others: DataFrame, other: str) -> DataFrame:
        first = F.min(F.struct(F.lit(LABEL).alias("label"), F.col(other).alias("partner"), F.col(f"{other}_label").alias("partner_label")))
        folded = others.groupBy(*NAMES, f"{other}_layer").agg(F.count("*").alias("n_partners"), first.alias("first"))
        return mine.join(folded, NAMES).select(
            "project_id", F.col(side).alias("focus"), F.col(f"{side}_label").alias("focus_label"), verb.alias("verb"),
            label_class(F.lit(LABEL)).alias("label_class"), "n_partners", "first")
    return told(callers, "source", targets, "target").unionByName(told(targets, "target", callers, "source"))
