"""Queries over the order files: symbol trees, bodies, calls, reads, evidence, the whole graph."""

import uuid
from functools import reduce

from pyspark.sql import functions as F

from codeloom.functions.symbols import is_relevant_package, kind_name
from codeloom.operators import calls as C, checks, edges as E, enrich as R, views as V
from codeloom.plans import bindings as B
from codeloom.plans.code_graph import build_graph
from codeloom.plans.sql import MANIFEST, ORDER_LAKE
from codeloom.sources.files import load_status as status_counts
from codeloom.session import shared_folder
from codeloom.sources.sinks import as_json_rows, read_graph, write_graph
from codeloom.sources.packages import classify, read_package_configs
from codeloom.sources.symbols import flatten_trees, link_parents


def _flat(spark, d):
    return flatten_trees(B.order_trees(spark, d))


def _range_text(c):
    return F.format_string("%d:%d-%d:%d", *[F.col(f"{c}.{n}") for n in ("sl", "sc", "el", "ec")])


def flat_symbols(spark, d):
    return _flat(spark, d).select(
        "project_id", "node_id", F.array_join(F.col("sym_path").cast("array<string>"), ".").alias("path"), "depth", "name", "kind",
        "detail", _range_text("rng").alias("rng"), _range_text("sel_rng").alias("sel"), "parent_uid", "parent_node_id")


def load_status(spark, d):
    return status_counts(B.order_trees(spark, d, failing=True))


def symbol_bodies(spark, d):
    found = R.slice_bodies(E.executables(_flat(spark, d)), B.order_files(spark, d))
    return found.select("project_id", "node_id", "body")


def _mentions(spark, d, flat):
    bodies = R.slice_bodies(
        E.executables(flat).select("project_id", "file_uri", "node_id", "rng", "sel_rng"), B.order_files(spark, d))
    return E.mentions(bodies.select("project_id", F.col("node_id").alias("source"), "body"))


def _named(flat):
    return flat.select("project_id", "node_id", "name", kind_name(F.col("kind")).alias("kind"))


def code_mentions(spark, d):
    return _mentions(spark, d, _flat(spark, d))


def call_edges(spark, d):
    flat = _flat(spark, d)
    return C.pairs(C.halves(_mentions(spark, d, flat), _named(flat)))


def call_fanout(spark, d):
    flat = _flat(spark, d)
    return E.call_fanout(_mentions(spark, d, flat), _named(flat))


def read_edges(spark, d):
    flat = _flat(spark, d)
    refs = B.order_refs(spark, d)
    callables = flat.filter(F.col("kind").isin(6, 12)).select(
        "project_id", "file_uri", "node_id", "ord", F.col("rng.sl").alias("sl"), F.col("rng.el").alias("el"))
    owners = E.line_owners(callables, refs.select(
        "project_id", F.col("ref_uri").alias("file_uri"), F.col("ref_line").alias("line")))
    targets = flat.filter(~F.col("kind").isin(6, 12)).select(
        "project_id", F.col("file_uri").alias("target_uri"), F.col("sel_rng.sl").alias("target_line"),
        F.col("sel_rng.sc").alias("target_char"), F.col("node_id").alias("target"), "name")
    return E.read_edges(refs, owners, targets, _mentions(spark, d, flat))


def line_owners(spark, d):
    """Order lines as ranges in one file per supplier; the points are part keys folded to lines."""
    lines = B.table(spark, d, "lineitem")
    project = F.col("l_returnflag").alias("project_id")
    uri = B.text("s", F.col("l_suppkey")).alias("file_uri")
    lo = F.col("l_quantity").cast("int")
    callables = lines.select(
        project, uri, B.text(F.col("l_orderkey"), ":", F.col("l_linenumber"), ":", F.col("l_partkey")).alias("node_id"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("ord"), lo.alias("sl"),
        # some ranges never end
        F.when(F.col("l_orderkey") % 500 == 0, 2147483647).otherwise(lo + F.col("l_linenumber") * 40).alias("el"))
    points = lines.select(project, uri, (F.col("l_partkey") % 400).cast("int").alias("line"))
    return E.line_owners(callables, points)


def _enriched(spark, d):
    return R.enrich(_flat(spark, d), B.order_files(spark, d), B.order_hovers(spark, d))


def type_evidence(spark, d):
    """Types and parameters by the evidence that tells them: detail, hover, source text."""
    return _enriched(spark, d).select("project_id", "node_id", "resolved_type", "return_type",
                                      F.array_join("params.name", ",").alias("param_names"), "access", "is_sdk")


def _graph(spark, d):
    return build_graph(_flat(spark, d), B.order_files(spark, d), B.order_hovers(spark, d), B.order_refs(spark, d),
                       B.order_packages(spark, d), keep_symbols=False)


def code_graph_edges(spark, d):
    return _graph(spark, d).edges.select("project_id", "source", "target", "label")


def code_graph_nodes(spark, d):
    return _graph(spark, d).nodes.select(
        "project_id", "node_id", "kind", "layer", F.col("source.type").alias("source_type"), "in_degree", "out_degree")


def graph_totals(spark, d):
    """Totals of the analysed graph; its packages are containers."""
    return _graph(spark, d).totals()


def graph_breakdown(spark, d):
    return _graph(spark, d).breakdown()


def graph_folder_edges(spark, d):
    return _graph(spark, d).folder_edges()


def graph_neighbourhood(spark, d):
    """Around every class and every load method of the analysed graph."""
    graph = _graph(spark, d)
    focus = graph.nodes.filter((F.col("kind") == "class") | F.col("label").startswith("load_")).select("project_id", "node_id")
    return graph.neighbourhood(focus)


def graph_verb_groups(spark, d):
    return _graph(spark, d).verb_groups()


def republished_graph(spark, d):
    """Every project is written, then some once more with other nodes and edges: which nodes and edges are read back."""
    flat = _flat(spark, d)
    nodes = flat.select("project_id", "node_id", kind_name(F.col("kind")).alias("kind"))
    edges = flat.filter(F.col("parent_node_id").isNotNull()).select(
        "project_id", F.col("node_id").alias("source"), F.col("parent_node_id").alias("target"), F.lit("MEMBER").alias("label"))
    folder = f"{shared_folder(spark).rstrip('/')}/graphs/{uuid.uuid4().hex}"
    write_graph(nodes, edges, folder)
    # the second analysis of p1 finds classes alone, that of p2 finds methods of one file in two
    again = nodes.filter("project_id = 'p1' AND kind = 'class'").unionByName(nodes.filter("project_id = 'p2'"))
    write_graph(again, edges.filter("project_id = 'p2' AND source LIKE '%load%'").withColumn("label", F.lit("AGAIN")), folder)
    nodes, edges = read_graph(spark, folder)
    rows = nodes.select("project_id", F.col("kind").alias("what")).unionByName(edges.select("project_id", F.col("label").alias("what")))
    return rows.groupBy("project_id", "what").agg(F.count("*").alias("n"))


def edge_export(spark, d):
    """One JSON text per edge of the analysed graph."""
    return as_json_rows(_graph(spark, d).edges.select("project_id", "source", "target", "label"), ["project_id"])


def graph_types(spark, d):
    """Declared types of the analysed graph: fields, parameters and returned values."""
    graph = _graph(spark, d)

    def rows(df, use):
        return df.select("project_id", "node_id", F.lit(use).alias("use"), F.col("ref.name").alias("type"),
                         F.col("ref.definition.file_uri").alias("defined_in"))
    return rows(graph.types, "field").unionByName(rows(graph.params, "parameter")).unionByName(rows(graph.returns, "return"))


def graph_findings(spark, d):
    """What else the analysis yields, counted by project: violations, profiles and imports."""
    graph = _graph(spark, d)
    parts = [graph.violations.select("project_id", F.concat(F.lit("violation:"), "rule").alias("finding")),
             graph.profiles.select("project_id", F.explode("profile.decisions").alias("finding")),
             graph.imports.select("project_id", F.concat(F.lit("import:"), "package").alias("finding"))]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("project_id", "finding").agg(F.count("*").alias("n"))


def provenance_counts(spark, d):
    return V.provenance_counts(_graph(spark, d).nodes)


def relevant_packages(spark, d):
    """Of the classified supplier manifests; framework and SDK packages are among them."""
    pkgs = classify(read_package_configs(B.supplier_configs(spark, d)), B.supplier_projects(spark, d))
    return pkgs.filter(is_relevant_package(F.col("name"), F.col("type"))).select("project_id", "name", "type")


def package_overview(spark, d):
    return V.package_overview(B.order_packages(spark, d))


def parent_links(spark, d):
    return link_parents(B.conversation_symbols(spark, d)).select(
        "project_id", F.array_join(F.col("sym_path").cast("array<string>"), ".").alias("path"), "node_id", "parent_node_id",
        "symbol_uid", "parent_uid")


def basic_facts(spark, d):
    """Access and SDK flag, left open where a symbol has no selection range."""
    rows = R.with_basics(B.conversation_symbols(spark, d))
    return rows.select("project_id", F.array_join(F.col("sym_path").cast("array<string>"), ".").alias("path"), "access", "is_sdk")


def violations(spark, d):
    """Conversation symbols whose parents are partly renamed away."""
    linked = link_parents(B.conversation_symbols(spark, d))
    lost = F.when(F.col("kind") == 12, F.concat("parent_uid", F.lit("#x"))).otherwise(F.col("parent_uid"))
    params = F.when(F.col("kind") == 9, F.array(F.struct(F.col("name").alias("name")), F.struct(F.lit("user_0").alias("name"))))
    odd = F.size("sym_path") + F.col("sym_path")[0]
    rows = linked.withColumn("parent_uid", lost).withColumn("detail", F.lit("(x)")).withColumn(
        "params", F.when(odd % 2 == 0, params))
    return checks.violations(rows).groupBy("project_id", "rule", "severity", "symbol_uid", "detail").agg(F.count("*").alias("n"))


_CONV = """conv AS (SELECT 'room' || (conv_id % 10) AS project_id, 'chat:' || conv_id AS file_uri, conv_id, turn, role, text FROM conversations),
  sym AS (
    SELECT project_id, file_uri, role, conv_id, turn, conv_id::VARCHAR AS path, 'Conv' || conv_id AS name, CASE WHEN conv_id % 3 = 0 THEN 10 ELSE 5 END AS kind,
      NULL::VARCHAR AS pname, NULL::INT AS pkind, NULL::VARCHAR AS gname FROM conv WHERE turn = 0
    UNION ALL SELECT project_id, file_uri, role, conv_id, turn, conv_id || '.' || turn, role || '_' || (turn % 3), CASE role WHEN 'assistant' THEN 6 WHEN 'user' THEN 9 ELSE 8 END,
      'Conv' || conv_id, CASE WHEN conv_id % 3 = 0 THEN 10 ELSE 5 END, NULL FROM conv
    UNION ALL SELECT project_id, file_uri, role, conv_id, turn, conv_id || '.' || turn || '.0', 't' || (length(text) % 7), 12,
      role || '_' || (turn % 3), CASE role WHEN 'assistant' THEN 6 WHEN 'user' THEN 9 ELSE 8 END, 'Conv' || conv_id FROM conv),
  pre(kind, prefix) AS (VALUES (5, 'class'), (10, 'enum'), (6, 'method'), (9, 'ctor'), (8, 'field'), (12, 'func')),
  linked AS (SELECT s.*, file_uri || coalesce('#parent:' || pname, '') || '#kind:' || a.prefix || '#name:' || name AS node_id,
      file_uri || coalesce('#parent:' || gname, '') || '#kind:' || b.prefix || '#name:' || pname AS parent_node_id,
      file_uri || '#' || name || '#' || s.kind AS symbol_uid, file_uri || '#' || pname || '#' || pkind AS parent_uid
    FROM sym s JOIN pre a ON a.kind = s.kind LEFT JOIN pre b ON b.kind = s.pkind)"""

# every symbol row from its order, without a join
_FLAT = """WITH o AS (
    SELECT o_orderkey AS k, 'p' || ((o_orderkey // 60) % 20) AS project_id,
      'file:///lake/p' || ((o_orderkey // 60) % 20) || '/lib/f' || (o_orderkey % 10) || '/order_' || o_orderkey || '.dart' AS u,
      CASE WHEN o_orderkey % 11 = 0 THEN 'Base' || (o_custkey % 9) ELSE 'Order' || o_orderkey END AS cls,
      'load_' || (o_orderkey // 3) AS load, 'item_' || (o_custkey % 10) AS item, 'send_' || o_orderkey AS send,
      ' extends Base' || ((o_custkey + 1) % 9) || ' implements Port' || (o_orderkey % 4) || '<int>' AS tail,
      66 + length(o_orderkey || '' || (o_orderkey // 3) || (o_orderkey // 2)) AS send_end FROM orders),
  m AS (
    SELECT project_id, u, cls, load, '0' AS path, 1 AS depth, cls AS name, 5 AS kind, 'class ' || cls || tail AS detail, '2:0-11:1' AS rng, '2:6-2:10' AS sel,
      'class' AS prefix, cls AS shown FROM o
    UNION ALL SELECT project_id, u, cls, load, '0.0', 2, item, 8, '', '3:2-3:40', '3:8-3:20', 'field', item FROM o
    UNION ALL SELECT project_id, u, cls, load, '0.1', 2, load, 6, 'Future<int> ' || load || '(int a, {required String b})', '5:2-9:3', '5:14-5:20', 'method', load FROM o
    UNION ALL SELECT project_id, u, cls, load, '0.1.0', 3, 'inner_' || (k % 3), 12, '', '6:4-6:39', '6:4-6:6', 'func', 'inner_' || (k % 3) FROM o WHERE k % 4 = 0
    UNION ALL SELECT project_id, u, cls, load, '0.2', 2, send, 6, '', '10:2-10:' || send_end, '10:7-10:12', 'method', send FROM o
    UNION ALL SELECT project_id, u, cls, load, '0.3', 2, cls, 9, '', '2:0-2:0', '2:0-2:1', 'ctor', '_default_' FROM o)
  SELECT project_id, path, depth, name, kind, detail, rng, sel,
    u || CASE depth WHEN 1 THEN '' WHEN 2 THEN '#parent:' || cls ELSE '#parent:' || load END || '#kind:' || prefix || '#name:' || shown AS node_id,
    CASE depth WHEN 2 THEN u || '#' || cls || '#5' WHEN 3 THEN u || '#' || load || '#6' END AS parent_uid,
    CASE depth WHEN 2 THEN u || '#kind:class#name:' || cls WHEN 3 THEN u || '#parent:' || cls || '#kind:method#name:' || load END AS parent_node_id
  FROM m"""

QUERIES = {
    "flat_symbols": (flat_symbols, _FLAT),
    "load_status": (load_status, f"""WITH {ORDER_LAKE} SELECT project_id, count(*) FILTER (status = 'ok') AS analysed,
        count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'error') AS failed, count(*) AS files,
        count(*) FILTER (status = 'ok') = 0 AS no_symbols FROM orows GROUP BY project_id"""),
    "symbol_bodies": (symbol_bodies, f"WITH {ORDER_LAKE} SELECT project_id, node_id, body FROM oid WHERE kind IN (6, 9, 12)"),
    "code_mentions": (code_mentions, f"WITH {ORDER_LAKE} SELECT DISTINCT project_id, source, name FROM mention"),
    "call_edges": (call_edges, f"WITH {ORDER_LAKE} SELECT * FROM calls"),
    "call_fanout": (call_fanout, f"""WITH {ORDER_LAKE}, m AS (SELECT project_id, name, count(DISTINCT source) AS n_callers FROM mention GROUP BY ALL),
        t AS (SELECT project_id, name, count(*) AS n_targets FROM oid WHERE kind IN (6, 12) GROUP BY ALL)
        SELECT project_id, name, n_callers, n_targets FROM m JOIN t USING (project_id, name)"""),
    "read_edges": (read_edges, f"WITH {ORDER_LAKE} SELECT * FROM reads"),
    "line_owners": (line_owners, """WITH c AS (SELECT l_returnflag AS project_id, 's' || l_suppkey AS file_uri,
          l_orderkey || ':' || l_linenumber || ':' || l_partkey AS node_id, l_orderkey AS a, l_linenumber AS b, l_partkey AS p,
          l_quantity::INT AS sl,
          CASE WHEN l_orderkey % 500 = 0 THEN 2147483647 ELSE l_quantity::INT + l_linenumber * 40 END AS el FROM lineitem),
        pts AS (SELECT DISTINCT l_returnflag AS project_id, 's' || l_suppkey AS file_uri, (l_partkey % 400)::INT AS line FROM lineitem)
        SELECT p.project_id, p.file_uri, p.line, first(node_id ORDER BY a, b, c.p) AS node_id FROM pts p JOIN c
          ON c.project_id = p.project_id AND c.file_uri = p.file_uri AND c.sl <= p.line AND c.el >= p.line GROUP BY ALL"""),
    "type_evidence": (type_evidence, f"""WITH {ORDER_LAKE} SELECT project_id, node_id,
        CASE WHEN kind = 8 THEN item_type END AS resolved_type,
        CASE WHEN path = '0.1' THEN 'a,b' WHEN path = '0.3' AND k % 2 = 0 THEN 'item_' || (c % 10) END AS param_names,
        CASE WHEN path = '0.1' THEN 'Future<int>' WHEN path = '0.2' AND k % 2 = 0 THEN 'Future<Hub>' END AS return_type,
        'public' AS access, false AS is_sdk FROM oid"""),
    "code_graph_edges": (code_graph_edges, f"WITH {ORDER_LAKE} SELECT * FROM alledges"),
    "code_graph_nodes": (code_graph_nodes, f"""WITH {ORDER_LAKE},
        i AS (SELECT project_id, target AS node_id, count(*) AS n FROM alledges GROUP BY ALL),
        o AS (SELECT project_id, source AS node_id, count(*) AS n FROM alledges GROUP BY ALL)
        SELECT b.project_id, b.node_id, kind, layer, source_type, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM onode b
        LEFT JOIN i ON i.project_id = b.project_id AND i.node_id = b.node_id LEFT JOIN o ON o.project_id = b.project_id AND o.node_id = b.node_id"""),
    "graph_totals": (graph_totals, f"""WITH {ORDER_LAKE}, n AS (SELECT project_id, count(*) AS n_nodes,
          count(*) FILTER (kind = 'package_container') AS n_containers FROM (SELECT DISTINCT project_id, node_id, kind FROM onode) GROUP BY ALL),
        e AS (SELECT project_id, count(*) AS n_edges FROM alledges GROUP BY ALL)
        SELECT n.project_id, n_nodes, n_containers, coalesce(n_edges, 0) AS n_edges FROM n LEFT JOIN e USING (project_id)"""),
    "graph_breakdown": (graph_breakdown, f"WITH {ORDER_LAKE} SELECT project_id, label, count(*) AS n_edges FROM alledges GROUP BY ALL"),
    "graph_folder_edges": (graph_folder_edges, f"""WITH {ORDER_LAKE},
        spot AS (SELECT project_id, node_id, 'lib/f' || (k % 10) AS folder, 'f' || (k % 10) AS feature FROM oid
          UNION ALL SELECT project_id, node_id, '', '' FROM onode WHERE kind = 'package_container'),
        j AS (SELECT e.project_id, s.folder AS sf, t.folder AS tf, s.feature AS se, t.feature AS te FROM alledges e
          JOIN spot s ON s.project_id = e.project_id AND s.node_id = e.source JOIN spot t ON t.project_id = e.project_id AND t.node_id = e.target)
        SELECT project_id, 'folder' AS level, sf AS source, tf AS target, count(*) AS n_edges FROM j WHERE sf <> tf GROUP BY ALL
        UNION ALL SELECT project_id, 'feature', se, te, count(*) FROM j WHERE se <> te GROUP BY ALL"""),
    "graph_neighbourhood": (graph_neighbourhood, f"""WITH {ORDER_LAKE}, f AS (SELECT project_id, node_id FROM oid WHERE kind = 5 OR starts_with(name, 'load_'))
        SELECT o.project_id, u.node_id AS focus, 'member' AS role, o.node_id AS other FROM oid o
          JOIN oid u ON u.file_uri = o.file_uri AND u.path = regexp_replace(o.path, '[.][0-9]+$', '')
          JOIN f ON f.node_id = u.node_id WHERE o.depth > 1 AND o.k % 10 IN (0, 2, 4, 6, 8, 9)
        UNION SELECT e.project_id, target, 'predecessor', source FROM alledges e JOIN f ON f.node_id = e.target
        UNION SELECT e.project_id, source, 'successor', target FROM alledges e JOIN f ON f.node_id = e.source"""),
    "graph_verb_groups": (graph_verb_groups, f"""WITH {ORDER_LAKE},
        named AS (SELECT project_id, node_id, name FROM oid
          UNION ALL SELECT project_id, node_id, coalesce(package, 'project_root') FROM onode WHERE kind = 'package_container'),
        e AS (SELECT a.project_id, a.source, a.target, s.name AS sl, t.name AS tl, a.label FROM alledges a
          JOIN named s ON s.project_id = a.project_id AND s.node_id = a.source JOIN named t ON t.project_id = a.project_id AND t.node_id = a.target),
        rel AS (SELECT project_id, source AS focus, sl AS focus_label, target AS partner, tl AS partner_label, label FROM e
          UNION ALL SELECT project_id, target, tl, source, sl, label FROM e)
        SELECT project_id, focus, focus_label, CASE label WHEN 'CALLS' THEN 'verb.calls' WHEN 'READS_FROM' THEN 'verb.readsFrom'
            WHEN 'EXTENDS' THEN 'verb.extends' WHEN 'USES_AS_TYPE' THEN 'verb.usesAsType' END AS verb,
          first(replace(lower(label), '_', '-') ORDER BY label, partner) AS label_class, count(*) AS n_partners,
          first(partner_label ORDER BY label, partner) AS first_partner
        FROM rel WHERE focus_label <> partner_label GROUP BY project_id, focus, focus_label, verb"""),
    "republished_graph": (republished_graph, f"""WITH {ORDER_LAKE},
        n AS (SELECT project_id, CASE prefix WHEN 'func' THEN 'function' WHEN 'ctor' THEN 'constructor' ELSE prefix END AS what FROM oid WHERE project_id <> 'p1' OR kind = 5
          UNION ALL SELECT project_id, CASE WHEN project_id = 'p2' THEN 'AGAIN' ELSE 'MEMBER' END FROM oid
            WHERE depth > 1 AND (project_id NOT IN ('p1', 'p2') OR (project_id = 'p2' AND node_id LIKE '%load%')))
        SELECT project_id, what, count(*) AS n FROM n GROUP BY ALL"""),
    "edge_export": (edge_export, f"""WITH {ORDER_LAKE} SELECT project_id, replace('{{"source":"' || source || '","target":"' || target || '","label":"' || label || '"}}',
        '<', '\u003c') AS json FROM alledges"""),
    "graph_types": (graph_types, f"""WITH {ORDER_LAKE},
        defs AS (SELECT project_id, name, first(file_uri ORDER BY file_uri) AS defined_in FROM oid WHERE kind = 5 GROUP BY ALL),
        used AS (
          SELECT project_id, node_id, 'field' AS use, item_type AS type, parent_name AS base FROM oid WHERE kind = 8
          UNION ALL SELECT project_id, node_id, 'parameter', item_type, parent_name FROM oid WHERE path = '0.3' AND k % 2 = 0
          UNION ALL SELECT project_id, node_id, 'parameter', unnest(['int', 'String']), '' FROM oid WHERE path = '0.1'
          UNION ALL SELECT project_id, node_id, 'return', 'Future<int>', 'int' FROM oid WHERE path = '0.1'
          UNION ALL SELECT project_id, node_id, 'return', 'Future<Hub>', 'Hub' FROM oid WHERE path = '0.2' AND k % 2 = 0)
        SELECT u.project_id, node_id, use, type, defined_in FROM used u LEFT JOIN defs d ON d.project_id = u.project_id AND d.name = u.base"""),
    "graph_findings": (graph_findings, f"""WITH {ORDER_LAKE}, f AS (
          SELECT project_id, 'decisions.conditionalDecisions' AS finding FROM oid WHERE path IN ('0.1', '0.1.0')
          UNION ALL SELECT project_id, 'import:' || unnest(['box_' || (c % 7), 'kit_' || (k % 5)]) FROM oid)
        SELECT project_id, finding, count(*) AS n FROM f GROUP BY ALL"""),
    "provenance_counts": (provenance_counts, f"""WITH {ORDER_LAKE} SELECT project_id, source_type, count(*) AS n_nodes FROM onode
        WHERE kind <> 'package_container' GROUP BY ALL"""),
    "relevant_packages": (relevant_packages, f"""WITH {MANIFEST} SELECT project_id, p.name AS name, type FROM typed
        WHERE type IN ('third_party', 'custom') OR (type = 'flutter_official' AND p.name NOT IN ('flutter', 'flutter_test'))"""),
    "package_overview": (package_overview, f"""WITH {ORDER_LAKE} SELECT project_id, CASE WHEN folder % 2 = 0 THEN 'developed' ELSE 'consumed' END AS package_group,
        count(*) AS n_packages FROM packs GROUP BY ALL"""),
    "parent_links": (parent_links, f"WITH {_CONV} SELECT project_id, path, node_id, parent_node_id, symbol_uid, parent_uid FROM linked"),
    "basic_facts": (basic_facts, f"""WITH {_CONV} SELECT project_id, path, CASE WHEN role <> 'system' THEN 'public' END AS access,
        CASE WHEN role <> 'system' THEN false END AS is_sdk FROM sym"""),
    "violations": (violations, f"""WITH {_CONV},
        v AS (SELECT *, CASE WHEN kind = 12 THEN parent_uid || '#x' ELSE parent_uid END AS up,
          ((length(path) - length(replace(path, '.', '')) + 1 + conv_id) % 2 = 0) AS with_params FROM linked),
        uids AS (SELECT DISTINCT project_id, symbol_uid FROM v),
        own AS (SELECT DISTINCT project_id, symbol_uid, kind FROM v),
        bad AS (
          SELECT project_id, 'orphan_parent' AS rule, 'error' AS severity, symbol_uid, up AS detail FROM v WHERE up IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM uids u WHERE u.project_id = v.project_id AND u.symbol_uid = v.up)
          UNION ALL SELECT project_id, 'orphan_in_file', 'error', symbol_uid, up FROM v WHERE up IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM v w WHERE w.project_id = v.project_id AND w.file_uri = v.file_uri AND w.symbol_uid = v.up)
          UNION ALL SELECT v.project_id, 'constructor_outside_class', 'error', v.symbol_uid, up FROM v JOIN own o
            ON o.project_id = v.project_id AND o.symbol_uid = v.up WHERE v.kind = 9 AND o.kind <> 5
          UNION ALL SELECT project_id, 'constructor_without_parameters', 'warning', symbol_uid, '(x)' FROM v WHERE kind = 9 AND NOT with_params
          UNION ALL SELECT v.project_id, 'parameter_without_field', 'warning', v.symbol_uid, p FROM (SELECT *, unnest([name, 'user_0']) AS p FROM v WHERE kind = 9 AND with_params) v
            JOIN own o ON o.project_id = v.project_id AND o.symbol_uid = v.up
            WHERE NOT EXISTS (SELECT 1 FROM v m WHERE m.project_id = v.project_id AND m.up = v.up AND m.name = v.p))
        SELECT project_id, rule, severity, symbol_uid, detail, count(*) AS n FROM bad GROUP BY ALL"""),
}
