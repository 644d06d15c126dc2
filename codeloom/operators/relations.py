"""Relations told in words: verbs, groups per focus node, narrative sentences."""

from pyspark.sql import DataFrame, functions as F

from codeloom.functions.text import format_message
from codeloom.functions.verbs import label_class, narrative_key, smart_verb
from codeloom.operators import calls as C
from codeloom.session import release, written
from codeloom.sources.messages import with_template


def verbed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges + ends -> label_class, verb key and the labels of both ends."""
    def end(side: str) -> DataFrame:
        return nodes.select(
            "project_id", F.col("node_id").alias(side), F.col("label").alias(f"{side}_label"),
            F.col("layer").alias(f"{side}_layer"))
    joined = (
        edges.select("project_id", "edge_ord", "source", "target", label_class(F.col("label")).alias("label_class"))
        .join(end("source"), ["project_id", "source"]).join(end("target"), ["project_id", "target"])
    )
    return joined.withColumn(
        "verb", smart_verb(F.col("label_class"), F.col("source_layer"), F.col("target_layer"), F.col("target_label")))


def focus_relations(verbed: DataFrame) -> DataFrame:
    """Every edge seen from both of its ends; partners with the focus's own label are dropped.

    One row per (focus, verb, partner edge): partner lists of busy nodes stay rows, never one array.
    """
    def seen(focus: str, partner: str):
        return F.struct(
            F.col(focus).alias("focus"), F.col(f"{focus}_label").alias("focus_label"),
            F.col(partner).alias("partner"), F.col(f"{partner}_label").alias("partner_label"))
    # both views of an edge come from one pass over the joined edges
    return (
        verbed.filter(F.col("source_label") != F.col("target_label"))
        .select("project_id", "verb", "label_class", "edge_ord",
                F.explode(F.array(seen("source", "target"), seen("target", "source"))).alias("e"))
        .select("project_id", "verb", "label_class", "edge_ord", "e.*")
    )


def verb_groups(relations: DataFrame) -> DataFrame:
    """Per focus and verb: label class of the first edge, number of partners, first partner."""
    rank = F.struct("edge_ord", "partner")
    return relations.groupBy("project_id", "focus", "focus_label", "verb").agg(
        F.min_by("label_class", rank).alias("label_class"), F.count("*").alias("n_partners"),
        F.min_by("partner_label", rank).alias("first_partner"))


def graph_verb_groups(edges: DataFrame, calls: C.Calls, nodes: DataFrame) -> DataFrame:
    """`verb_groups` of an analysed graph: its few other edges one by one, its calls folded by name.

    edges(project_id, source, target, label) without the calls. Their order is that of (label, partner). What is read of
    the nodes, and both kinds of rows, are written by steps of their own, whose exchange files go before the rows meet.
    """
    ends = written(nodes.select("project_id", "node_id", "label", "layer"))
    few = focus_relations(verbed_edges(edges.withColumn("edge_ord", F.col("label")), ends))
    first = F.struct(F.col("edge_ord").alias("label"), "partner", "partner_label")
    rows = few.select("project_id", "focus", "focus_label", "verb", "label_class", F.lit(1).cast("bigint").alias("n_partners"), first.alias("first"))
    every = written(rows).unionByName(written(C.relation_groups(calls, ends)))
    release(ends)
    return every.groupBy("project_id", "focus", "focus_label", "verb").agg(
        F.min_by("label_class", "first").alias("label_class"), F.sum("n_partners").alias("n_partners"),
        F.min("first").getField("partner_label").alias("first_partner"))


def narrate(rows: DataFrame, messages: DataFrame | dict, lang: str, source: str, target: str, verb: str, out: str) -> DataFrame:
    """Sentence about one relation."""
    def bold(c: str):
        return F.concat(F.lit("<strong>"), F.col(c), F.lit("</strong>"))
    keyed = rows.withColumn("_key", narrative_key(F.col(verb)))
    return with_template(keyed, messages, lang, "_key", "_template").withColumn(
        out, format_message(F.col("_template"), bold(source), bold(target))).drop("_key", "_template")


def relation_summaries(groups: DataFrame, messages: dict, lang: str = "en") -> DataFrame:
    """One text per focus and verb: a sentence for one partner, a count for several.

    messages is a catalogue as `builtin_messages` gives it; its texts become literals of the plan.
    """
    told = narrate(groups, messages, lang, "focus_label", "first_partner", "verb", "_one")
    told = with_template(told, messages, lang, "verb", "_verb")
    told = with_template(told.withColumn("_many", F.lit("details.multipleComponents")), messages, lang, "_many", "_t")
    many = format_message(F.col("_t"), F.col("focus_label"), F.lower("_verb"), F.col("n_partners").cast("string"))
    return told.withColumn("summary", F.when(F.col("n_partners") == 1, F.col("_one")).otherwise(many)).drop(
        "_one", "_verb", "_many", "_t")
