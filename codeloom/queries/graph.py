"""Graph queries over the trade graph and the event walks."""

from pyspark.sql import DataFrame, functions as F

from codeloom.functions.verbs import verb_category
from codeloom.operators import edges as E, graph as G, relations as R, views as V
from codeloom.operators.packages import package_edges
from codeloom.plans import bindings as B
from codeloom.plans.sql import EVENT_EDGES, MESSAGES_SQL, TRADE, VERBS_SQL, flow_sql
from codeloom.sources.messages import builtin_messages
from codeloom.sources.sinks import as_json_rows, with_ordinals


def node_degrees(spark, d):
    nodes = B.trade_nodes(spark, d).select("project_id", "node_id")
    return G.with_degrees(nodes, B.trade_edges(spark, d))


def top_coupled(spark, d):
    """All nodes with their coupling and its rank; equal degrees share a rank."""
    return G.degree_ranks(node_degrees(spark, d))


def edge_breakdown(spark, d):
    return G.edge_breakdown(B.trade_edges(spark, d))


def offered_edges(spark, d) -> DataFrame:
    """The trade edges with repeats, self loops, unknown and empty ends among them."""
    def ends(source, target):
        return F.struct(source.alias("source"), target.alias("target"))
    source, target = F.col("source"), F.col("target")
    offered = F.array(ends(source, target), ends(source, target), ends(source, source),
                      ends(source, F.concat(F.lit("ghost:"), target)), ends(F.lit(""), target))
    return B.trade_edges(spark, d).select("project_id", "label", F.explode(offered).alias("e")).select(
        "project_id", "e.source", "e.target", "label")


def admitted_edges(spark, d):
    return E.admit(offered_edges(spark, d), B.trade_nodes(spark, d)).select("project_id", "source", "target", "label")


def edge_ordinals(spark, d):
    order = ["edge_ord", "source", "target", "label"]
    return with_ordinals(B.trade_edges(spark, d), "project_id", order, "ordinal").select(
        "project_id", "source", "target", "label", F.concat(F.lit("e"), F.col("ordinal").cast("string")).alias("edge_name"))


def _verbed(spark, d):
    return R.verbed_edges(B.trade_edges(spark, d, by_source=True), B.trade_nodes(spark, d))


def smart_verbs(spark, d):
    return _verbed(spark, d).select("project_id", "source", "target", "label_class", "verb")


def verb_categories(spark, d):
    return _verbed(spark, d).groupBy("verb").agg(F.count("*").alias("n")).withColumn(
        "category", verb_category(F.col("verb")))


def relation_partners(spark, d):
    return R.focus_relations(_verbed(spark, d)).select("project_id", "focus", "verb", "label_class", "partner")


def verb_groups(spark, d):
    return R.verb_groups(R.focus_relations(_verbed(spark, d))).select(
        "project_id", "focus", "verb", "label_class", "n_partners", "first_partner")


def relation_summaries(spark, d):
    groups = R.verb_groups(R.focus_relations(_verbed(spark, d)))
    return R.relation_summaries(groups, builtin_messages(), "en").select("project_id", "focus", "verb", "summary")


def narrative_sentences(spark, d):
    told = R.narrate(_verbed(spark, d), builtin_messages(), "es", "source_label", "target_label", "verb", "sentence")
    return told.select("project_id", "source", "target", "label_class", "sentence")


def _path(traces):
    return traces.select("project_id", "start", F.array_join("path", ">").alias("path"), "complete")


def flow_trace_events(spark, d):
    edges = B.event_edges(spark, d)
    starts = edges.select("project_id", F.explode(F.array("source", "target")).alias("start")).distinct()
    return _path(G.trace_flow(edges, starts))


def flow_trace_trade(spark, d):
    starts = B.trade_nodes(spark, d).select("project_id", F.col("node_id").alias("start"))
    return _path(G.trace_flow(B.trade_edges(spark, d), starts))


def focus_neighbourhood(spark, d):
    nodes = B.trade_nodes(spark, d)
    focus = nodes.filter(F.col("kind").isin("class", "folder")).select("project_id", "node_id")
    return G.neighbourhood(nodes, B.trade_edges(spark, d, by_source=True), focus)


def layer_overview(spark, d):
    return V.layer_overview(B.trade_nodes(spark, d))


def list_search(spark, d):
    return V.search_layer(B.trade_nodes(spark, d), "state", "BOLT").select("project_id", "node_id", "label")


def _placed(spark, d):
    rel = F.col("rel_path")
    return B.trade_nodes(spark, d).withColumn("feature", V.feature_of(rel)).withColumn("folder", V.folder_of(rel))


def folder_rollup(spark, d):
    return V.folder_rollup(_placed(spark, d))


def folder_edges(spark, d):
    return V.lifted_edges(B.trade_edges(spark, d), _placed(spark, d))


def member_counts(spark, d):
    return V.members_per_component(B.trade_nodes(spark, d))


def focus_lookup(spark, d):
    """Requests by part name (many nodes share one) and by supplier id."""
    asked = B.table(spark, d, "part").select(F.col("p_name").alias("request")).unionByName(
        B.table(spark, d, "supplier").select(B.text("supplier:", F.col("s_suppkey")).alias("request")))
    return V.focus_nodes(B.trade_nodes(spark, d), asked.withColumn("project_id", F.lit(B.TRADE)))


def package_dependencies(spark, d):
    packaged = B.trade_nodes(spark, d).select("project_id", "node_id", "package")
    return package_edges(B.trade_edges(spark, d), packaged)


def json_export(spark, d):
    nodes = G.with_degrees(B.trade_nodes(spark, d), B.trade_edges(spark, d))
    tagged = nodes.withColumn("label", F.concat("label", F.lit("<T>\t")))
    return as_json_rows(tagged.select("project_id", "node_id", "label", "in_degree", "out_degree"), ["project_id"])


_TRADE_REL = f"""{TRADE}, {VERBS_SQL}, rel AS (
  SELECT source AS focus, source_label AS focus_label, target AS partner, target_label AS partner_label, verb, label_class, edge_ord FROM verbed
  UNION ALL
  SELECT target, target_label, source, source_label, verb, label_class, edge_ord FROM verbed),
  relations AS (SELECT * FROM rel WHERE focus_label <> partner_label),
  grouped AS (
    SELECT focus, focus_label, verb, first(label_class ORDER BY edge_ord, partner) AS label_class, count(*) AS n_partners,
           first(partner_label ORDER BY edge_ord, partner) AS first_partner
    FROM relations GROUP BY ALL)"""

_DEGREES = f"""{TRADE},
  deg AS (SELECT n.node_id, n.label, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree FROM nodes n
    LEFT JOIN (SELECT target, count(*) AS c FROM edges GROUP BY 1) i ON i.target = n.node_id
    LEFT JOIN (SELECT source, count(*) AS c FROM edges GROUP BY 1) o ON o.source = n.node_id)"""

_PLACED = f"""{TRADE}, placed AS (
  SELECT node_id,
    CASE WHEN contains(regexp_replace(rel_path, '^lib/', ''), '/') THEN string_split(regexp_replace(rel_path, '^lib/', ''), '/')[1] ELSE '' END AS feature,
    CASE WHEN contains(rel_path, '/') THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE '' END AS folder
  FROM nodes)"""

QUERIES = {
    "node_degrees": (node_degrees, f"WITH {_DEGREES} SELECT 'trade' AS project_id, node_id, in_degree, out_degree FROM deg"),
    "top_coupled": (top_coupled, f"""WITH {_DEGREES} SELECT 'trade' AS project_id, node_id, in_degree, out_degree,
        in_degree + out_degree AS degree, rank() OVER (ORDER BY in_degree + out_degree DESC) AS rank FROM deg"""),
    "edge_breakdown": (edge_breakdown, f"WITH {TRADE} SELECT 'trade' AS project_id, label, count(*) AS n_edges FROM edges GROUP BY label"),
    "admitted_edges": (admitted_edges, f"""WITH {TRADE} SELECT DISTINCT 'trade' AS project_id, source, target, label FROM edges
        WHERE source <> target AND source IN (SELECT node_id FROM nodes) AND target IN (SELECT node_id FROM nodes)"""),
    "edge_ordinals": (edge_ordinals, f"""WITH {TRADE} SELECT 'trade' AS project_id, source, target, label,
        'e' || (row_number() OVER (ORDER BY edge_ord, source, target, label) - 1) AS edge_name FROM edges"""),
    "smart_verbs": (smart_verbs, f"""WITH {TRADE}, {VERBS_SQL}
        SELECT 'trade' AS project_id, source, target, label_class, verb FROM verbed"""),
    "verb_categories": (verb_categories, f"""WITH {TRADE}, {VERBS_SQL}
        SELECT verb, count(*) AS n, CASE
          WHEN verb IN ('verb.showsUser', 'verb.buildsAndShows') THEN 'ui'
          WHEN verb IN ('verb.readsFrom', 'verb.managesState') THEN 'data'
          WHEN verb IN ('verb.delegates', 'verb.notifies') THEN 'logic'
          WHEN verb IN ('verb.extends', 'verb.implements') THEN 'inheritance'
          WHEN verb = 'verb.composedOf' THEN 'composition'
          WHEN verb = 'verb.formats' THEN 'formatting' ELSE 'other' END AS category
        FROM verbed GROUP BY verb"""),
    "relation_partners": (relation_partners, f"""WITH {_TRADE_REL}
        SELECT 'trade' AS project_id, focus, verb, label_class, partner FROM relations"""),
    "verb_groups": (verb_groups, f"""WITH {_TRADE_REL}
        SELECT 'trade' AS project_id, focus, verb, label_class, n_partners, first_partner FROM grouped"""),
    "relation_summaries": (relation_summaries, f"""WITH {_TRADE_REL}, {MESSAGES_SQL}
        SELECT 'trade' AS project_id, focus, g.verb AS verb, CASE WHEN n_partners = 1
          THEN replace(replace(coalesce(s.en, d.en), '{{0}}', '<strong>' || focus_label || '</strong>'), '{{1}}', '<strong>' || first_partner || '</strong>')
          ELSE focus_label || ' ' || lower(t.en) || ' ' || n_partners || ' distinct components in the project.' END AS summary
        FROM grouped g JOIN texts t ON t.key = g.verb
        LEFT JOIN texts s ON s.key = 'narrative.' || g.verb, (SELECT en FROM texts WHERE key = 'narrative.default') d"""),
    "narrative_sentences": (narrative_sentences, f"""WITH {TRADE}, {VERBS_SQL}, {MESSAGES_SQL}
        SELECT 'trade' AS project_id, source, target, label_class,
          replace(replace(coalesce(s.es, d.es), '{{0}}', '<strong>' || source_label || '</strong>'), '{{1}}', '<strong>' || target_label || '</strong>') AS sentence
        FROM verbed v LEFT JOIN texts s ON s.key = 'narrative.' || v.verb, (SELECT es FROM texts WHERE key = 'narrative.default') d"""),
    "flow_trace_events": (flow_trace_events, flow_sql(
        EVENT_EDGES, "SELECT DISTINCT project_id, source AS start FROM edges UNION SELECT DISTINCT project_id, target FROM edges")),
    "flow_trace_trade": (flow_trace_trade, flow_sql(
        TRADE + ", tagged AS (SELECT 'trade' AS project_id, * FROM edges)",
        "SELECT 'trade' AS project_id, node_id AS start FROM nodes", "tagged")),
    "focus_neighbourhood": (focus_neighbourhood, f"""WITH {TRADE}, f AS (SELECT node_id FROM nodes WHERE kind IN ('class', 'folder'))
        SELECT 'trade' AS project_id, parent AS focus, 'member' AS role, node_id AS other FROM nodes WHERE parent IN (SELECT node_id FROM f)
        UNION SELECT 'trade', target, 'predecessor', source FROM edges WHERE target IN (SELECT node_id FROM f)
        UNION SELECT 'trade', source, 'successor', target FROM edges WHERE source IN (SELECT node_id FROM f)"""),
    "layer_overview": (layer_overview, f"""WITH {TRADE} SELECT 'trade' AS project_id, layer, count(*) AS n_components
        FROM nodes WHERE layer <> 'member' GROUP BY layer"""),
    "list_search": (list_search, f"""WITH {TRADE} SELECT 'trade' AS project_id, node_id, label FROM nodes
        WHERE layer = 'state' AND contains(lower(label), 'bolt')"""),
    "folder_rollup": (folder_rollup, f"""WITH {_PLACED}, p AS (SELECT 'trade' AS project_id, * FROM placed)
        SELECT project_id, feature, folder, count(*) AS n_nodes, grouping_id(project_id, feature, folder)::INT AS level
        FROM p GROUP BY ROLLUP (project_id, feature, folder)"""),
    "folder_edges": (folder_edges, f"""WITH {_PLACED}, j AS (
          SELECT s.folder AS sf, t.folder AS tf, s.feature AS se, t.feature AS te FROM edges e
          JOIN placed s ON s.node_id = e.source JOIN placed t ON t.node_id = e.target)
        SELECT 'trade' AS project_id, 'folder' AS level, sf AS source, tf AS target, count(*) AS n_edges FROM j WHERE sf <> tf GROUP BY ALL
        UNION ALL SELECT 'trade', 'feature', se, te, count(*) FROM j WHERE se <> te GROUP BY ALL"""),
    "member_counts": (member_counts, f"""WITH {TRADE} SELECT 'trade' AS project_id, parent AS node_id, count(*) AS n_members
        FROM nodes WHERE parent IS NOT NULL GROUP BY parent"""),
    "focus_lookup": (focus_lookup, f"""WITH {TRADE}, asked AS (
          SELECT p_name AS request FROM part UNION SELECT 'supplier:' || s_suppkey FROM supplier)
        SELECT 'trade' AS project_id, request, first(node_id ORDER BY rank, key) AS node_id
        FROM asked JOIN nodes ON label = request OR node_id = request GROUP BY request"""),
    "package_dependencies": (package_dependencies, f"""WITH {TRADE}
        SELECT DISTINCT 'trade' AS project_id, CASE WHEN s.package IS NULL THEN 'project_root' ELSE 'package_container:' || s.package END AS source,
          'package_container:' || t.package AS target, 'USES_AS_TYPE' AS label
        FROM edges e JOIN nodes s ON s.node_id = e.source JOIN nodes t ON t.node_id = e.target
        WHERE t.package IS NOT NULL AND (s.package IS NULL OR s.package <> t.package)"""),
    "json_export": (json_export, f"""WITH {_DEGREES} SELECT 'trade' AS project_id,
        '{{"node_id":"' || node_id || '","label":"' || label || '\\u003cT>\\\\t","in_degree":' || in_degree || ',"out_degree":' || out_degree || '}}' AS json
        FROM deg"""),
}
