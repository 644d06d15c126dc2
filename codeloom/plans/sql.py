"""SQL twins of the bindings, written for the checking engine."""

# --- trade graph ---------------------------------------------------------------------
_LAYERS = "['view','state','service','model','utility']"
TRADE = f"""places AS (
    SELECT n_nationkey, lower('lib/' || r_name || '/' || n_name) AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
  nodes AS (
    SELECT 'region:' || r_regionkey AS node_id, 1 AS rank, r_regionkey::BIGINT AS key, r_name AS label, 'folder' AS kind,
      'utility' AS layer, NULL::VARCHAR AS parent, lower('lib/' || r_name) AS rel_path, NULL::VARCHAR AS package FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 2, n_nationkey, n_name, 'folder', 'utility', 'region:' || n_regionkey, lower('lib/' || n_name), NULL FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 3, c_custkey, c_name, 'class', {_LAYERS}[(c_custkey % 5 + 1)::INT], 'nation:' || c_nationkey,
      place || '/customer_' || c_custkey || '.dart', NULL FROM customer JOIN places ON c_nationkey = n_nationkey
    UNION ALL SELECT 'supplier:' || s_suppkey, 4, s_suppkey, s_name, 'class', {_LAYERS}[((s_suppkey + 1) % 5 + 1)::INT], 'nation:' || s_nationkey,
      place || '/supplier_' || s_suppkey || '.dart', 'supply_' || s_nationkey FROM supplier JOIN places ON s_nationkey = n_nationkey
    UNION ALL SELECT 'part:' || p_partkey, 5, p_partkey,
      p_name || ['Dialog','Formatter','Analytics','SnackBar','','','',''][(p_partkey % 8 + 1)::INT], 'method', {_LAYERS}[(p_partkey % 5 + 1)::INT], NULL,
      'packages/' || lower(replace(p_brand, '#', '_')) || '/part_' || p_partkey || '.dart', lower(replace(p_brand, '#', '_')) FROM part),
  lines AS (SELECT l.*, o_custkey, l_orderkey * 8 + l_linenumber AS at_ord FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
  edges AS (
    SELECT source, target, label, min(at_ord) AS edge_ord FROM (
      SELECT 'customer:' || o_custkey AS source, 'part:' || l_partkey AS target,
        CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'N' THEN 'INSTANCE_OF' ELSE 'USES_AS_TYPE' END AS label, at_ord FROM lines
      UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'READS_FROM', at_ord FROM lines
      UNION ALL SELECT 'supplier:' || l_suppkey, 'customer:' || o_custkey, 'WRITES_TO', at_ord FROM lines) GROUP BY ALL)"""

DEFAULT_VERB_SQL = """CASE label_class WHEN 'extends' THEN 'verb.extends' WHEN 'implements' THEN 'verb.implements' WHEN 'calls' THEN 'verb.calls'
      WHEN 'reads-from' THEN 'verb.readsFrom' WHEN 'writes-to' THEN 'verb.writesTo' WHEN 'instance-of' THEN 'verb.instanceOf'
      WHEN 'uses-as-type' THEN 'verb.usesAsType' ELSE 'verb.unknown' END"""

VERBS_SQL = f"""joined AS (
    SELECT e.*, replace(lower(e.label), '_', '-') AS label_class, s.label AS source_label, t.label AS target_label,
      s.layer AS sl, t.layer AS tl, lower(t.label) AS tn
    FROM edges e JOIN nodes s ON s.node_id = e.source JOIN nodes t ON t.node_id = e.target),
  verbed AS (SELECT *, CASE
      WHEN sl = 'view' AND tl = 'state' THEN 'verb.reactsTo'
      WHEN label_class = 'instance-of' AND sl = 'view' AND tl = 'view' THEN 'verb.buildsAndShows'
      WHEN label_class = 'calls' AND sl = 'state' AND tl = 'service' THEN 'verb.delegates'
      WHEN label_class = 'reads-from' AND sl = 'state' AND tl = 'model' THEN 'verb.managesState'
      WHEN label_class = 'instance-of' AND sl = 'service' AND tl = 'model' THEN 'verb.assembles'
      WHEN sl = 'model' AND tl = 'model' THEN 'verb.composedOf'
      WHEN label_class = 'calls' AND contains(tn, 'analytics') THEN 'verb.reportsEvent'
      WHEN label_class = 'calls' AND (contains(tn, 'dialog') OR contains(tn, 'snackbar') OR contains(tn, 'alert')) THEN 'verb.showsUser'
      WHEN label_class = 'calls' AND contains(tn, 'formatter') THEN 'verb.formats'
      ELSE {DEFAULT_VERB_SQL} END AS verb FROM joined)"""


def _messages_sql() -> str:
    import json
    from codeloom.sources.messages import CATALOGUE
    en, es = (json.loads((CATALOGUE / f"{lang}.json").read_text(encoding="utf-8")) for lang in ("en", "es"))
    rows = ", ".join(f"('{k}', '{v}', '{es[k]}')" for k, v in en.items())
    return f"texts(key, en, es) AS (VALUES {rows})"


MESSAGES_SQL = _messages_sql()

# --- flow traces ---------------------------------------------------------------------
EVENT_EDGES = """edges AS (SELECT event_type AS project_id, event_id AS edge_ord, 'n' || user_id AS source,
    'n' || json_extract_string(props, '$.k') AS target,
    CASE WHEN event_id % 2 = 0 THEN 'READS_FROM' ELSE 'WRITES_TO' END AS label FROM events)"""


def flow_sql(ctes: str, starts: str, edges: str = "edges") -> str:
    return f"""WITH RECURSIVE {ctes},
  back AS (SELECT project_id, here, list(other ORDER BY o, other) AS nbrs FROM (
    SELECT project_id, target AS here, source AS other, min(edge_ord) AS o FROM {edges} WHERE label = 'WRITES_TO' GROUP BY ALL) GROUP BY ALL),
  fwd AS (SELECT project_id, here, list(other ORDER BY o, other) AS nbrs FROM (
    SELECT project_id, source AS here, target AS other, min(edge_ord) AS o FROM {edges} WHERE label = 'READS_FROM' GROUP BY ALL) GROUP BY ALL),
  starts AS ({starts}),
  b AS (SELECT project_id, start, start AS here, [start] AS path, 0 AS hop FROM starts
    UNION ALL
    SELECT project_id, start, nxt, list_concat([nxt], path), hop + 1 FROM (
      SELECT b.*, list_filter(back.nbrs, lambda x: NOT list_contains(b.path, x))[1] AS nxt
      FROM b JOIN back ON back.project_id = b.project_id AND back.here = b.here WHERE hop < 10) WHERE nxt IS NOT NULL),
  b_end AS (SELECT project_id, start, first(path ORDER BY hop DESC) AS path FROM b GROUP BY ALL),
  f AS (SELECT project_id, start, start AS here, path, 0 AS hop FROM b_end
    UNION ALL
    SELECT project_id, start, nxt, list_concat(path, [nxt]), hop + 1 FROM (
      SELECT f.*, list_filter(fwd.nbrs, lambda x: NOT list_contains(f.path, x))[1] AS nxt
      FROM f JOIN fwd ON fwd.project_id = f.project_id AND fwd.here = f.here WHERE hop < 10) WHERE nxt IS NOT NULL),
  finished AS (SELECT project_id, start, first(path ORDER BY hop DESC) AS path FROM f GROUP BY project_id, start)
SELECT e.project_id, e.start, array_to_string(e.path, '>') AS path,
  NOT (len(b_end.path) > 10 AND coalesce(len(list_filter(back.nbrs, lambda x: NOT list_contains(b_end.path, x))) > 0, false))
    AND NOT (len(e.path) - len(b_end.path) >= 10 AND coalesce(len(list_filter(fwd.nbrs, lambda x: NOT list_contains(e.path, x))) > 0, false)) AS complete
FROM finished e JOIN b_end ON b_end.project_id = e.project_id AND b_end.start = e.start
LEFT JOIN back ON back.project_id = e.project_id AND back.here = b_end.path[1]
LEFT JOIN fwd ON fwd.project_id = e.project_id AND fwd.here = e.path[len(e.path)]"""


# --- part classes with order-line members --------------------------------------------
def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _at(values: list[str], index: str) -> str:
    return f"{_list(values)}[({index} % {len(values)} + 1)::INT]"


def _part_lake() -> str:
    from codeloom.plans import bindings as b
    base = f"CASE WHEN k % 8 = 2 THEN 'Shape' || (k % 3) || '<X, Y>' ELSE {_at(b.BASES, 'k')} END"
    plain = f"'C' || k || {_at(b.CLASS_SUFFIX, 'k')}"
    return f"""raw AS (SELECT *, p_partkey AS k FROM part),
  named AS (SELECT *, CASE WHEN k % 9 = 0 THEN 'Shape' || (k % 4) WHEN k % 13 = 0 THEN {plain} || '<T>' ELSE {plain} END AS name,
      CASE WHEN k % 50 = 0 THEN 'file:///opt/dart-sdk/lib/' ELSE 'file:///lake/' || p_brand || '/lib/' || lower(p_type) || '/' END
        || 'part_' || k || '.dart' AS file_uri FROM raw),
  classes AS (SELECT p_brand AS project_id, file_uri, k AS part, name, CASE WHEN p_size % 10 = 0 THEN 10 ELSE 5 END AS kind,
      k % 3 <> 0 AS declared, {base} AS base, k % 4 = 0 AS mixed, CASE WHEN k % 5 = 0 THEN 'Repo' || (k % 6) || '<T>' END AS port,
      CASE WHEN k % 3 = 0 THEN '' ELSE 'class ' || name || ' extends ' || {base}
        || CASE WHEN k % 4 = 0 THEN ' with MixA, MixB<int, String>' ELSE '' END
        || CASE WHEN k % 5 = 0 THEN ' implements Repo' || (k % 6) || '<T>, Shape3' ELSE '' END END AS detail
    FROM named),
  keyed AS (SELECT l.*, c.project_id, c.file_uri, c.name AS parent_name, c.kind AS parent_kind, l_orderkey AS ok, l_linenumber AS ln, l_suppkey AS sk,
      CAST(l_extendedprice * 100 AS BIGINT) AS cents FROM lineitem l JOIN classes c ON l_partkey = c.part),
  kinded AS (SELECT *, CASE ln WHEN 1 THEN 9 WHEN 2 THEN 6 WHEN 3 THEN 6 WHEN 7 THEN 6 WHEN 4 THEN 12 WHEN 5 THEN 8 ELSE 7 END AS kind,
      CASE ln WHEN 1 THEN CASE WHEN sk % 2 = 0 THEN parent_name ELSE parent_name || '.named' END
        WHEN 2 THEN 'ship_' || sk WHEN 3 THEN {_at(b.METHOD_NAMES, 'ok')} WHEN 4 THEN 'calc_' || sk
        WHEN 5 THEN {_at(b.FIELD_NAMES, 'ok')} WHEN 6 THEN 'prop_' || (ok % 5) ELSE 'ship_' || (sk + 1) END AS name FROM keyed),
  members AS (SELECT *, ok % {len(b.SIGNATURES)} AS shape, {_at(b.FIELD_TYPES, 'ok')} AS ftype, {_at(b.RETURN_TYPES, 'sk')} AS rtype,
      CASE WHEN kind IN (7, 8) THEN '@Doc late final ' || {_at(b.FIELD_TYPES, 'ok')} || ' ' || name
        WHEN kind = 9 THEN {_at(b.SIGNATURES, 'ok')}
        ELSE {_at(b.RETURN_TYPES, 'sk')} || ' ' || name || {_at(b.SIGNATURES, 'ok')} END AS detail,
      CASE kind WHEN 9 THEN 'ctor' WHEN 6 THEN 'method' WHEN 12 THEN 'func' WHEN 8 THEN 'field' ELSE 'prop' END AS prefix FROM kinded),
  ids AS (SELECT *, file_uri || '#parent:' || parent_name || '#kind:' || prefix || '#name:'
      || CASE WHEN kind = 9 AND name = parent_name THEN '_default_' ELSE name END AS node_id,
      file_uri || '#' || name || '#' || kind AS symbol_uid,
      file_uri || '#kind:' || CASE parent_kind WHEN 5 THEN 'class' ELSE 'enum' END || '#name:' || parent_name AS parent_id FROM members)"""


PART_LAKE = _part_lake()

# what every signature shape reads as: shape, pos, name, type, named, required, optional
SIGNATURE_PARAMS = """params(shape, pos, name, type, is_named, is_required, is_optional) AS (VALUES
    (0, 1, 'a', 'int', false, false, false), (0, 2, 'b', 'String', false, false, false),
    (1, 1, 'qty', 'self_field:qty', true, true, false), (1, 2, 'state', 'self_field:state', true, false, false),
    (2, 1, 'm', 'Map<String, List<Shape1>>', false, false, false), (2, 2, 'n', 'int?', false, false, true),
    (3, 1, 'cb', 'void Function(int, String)', false, false, false), (3, 2, 'x', 'Foo<Bar>', true, true, false),
    (5, 1, 'qty', 'dynamic', false, false, false),
    (6, 1, NULL, 'List<int>', false, false, false),
    (7, 1, 'a', 'final int', false, false, false), (7, 2, 'b', 'Base', false, false, false),
    (8, 1, 'm', 'Map<A, B<C, D<E, F<G, H>>>>', false, false, false), (8, 2, 'z', 'int', false, false, false),
    (9, 1, 'qty', 'self_field:qty', true, false, false), (9, 2, 'y', 'int', true, false, false), (9, 3, 'k', 'Map<int, Set<int>>', true, true, false),
    (10, 1, 'cb', 'void Function(int Function(String Function(int, int), int))', false, false, false), (10, 2, 'z', 'int', false, false, true),
    (11, 1, 'qty', 'self_field:qty', true, false, false), (11, 2, 'state', 'self_field:state', true, false, false))"""
# the last shape can only be read as the own fields of a constructor

# --- order files ---------------------------------------------------------------------
ORDER_LAKE = """orows AS (SELECT o_orderkey AS k, o_custkey AS c, 'p' || ((o_orderkey // 60) % 20) AS project_id,
      'file:///lake/p' || ((o_orderkey // 60) % 20) || '/lib/f' || (o_orderkey % 10) || '/order_' || o_orderkey || '.dart' AS file_uri,
      CASE WHEN o_orderkey % 11 = 0 THEN 'Base' || (o_custkey % 9) ELSE 'Order' || o_orderkey END AS cname,
      o_orderkey // 3 AS third, o_orderkey // 2 AS half, o_orderkey // 2 // 3 AS sixth, o_orderkey % 10 AS folder,
      CASE WHEN o_orderkey % 97 = 0 THEN 'error' WHEN o_orderkey % 50 = 0 THEN 'empty' ELSE 'ok' END AS status FROM orders),
  okrows AS (SELECT *, 'class ' || cname || ' extends Base' || ((c + 1) % 9) || ' implements Port' || (k % 4) || '<int>' AS header,
      'Future<int> load_' || third || '(int a, {required String b})' AS load_decl,
      '  void send_' || k || '() { var s = ''ünï ' || chr(128512) || ' ''; await load_' || third || '(1); hub.send_' || half || '(); }' AS send_line,
      '    if (a.isEmpty) { return new Box(a); } /* skip_' || c || '(1) */' AS line6,
      '    emit(load_' || sixth || '(a)); track("send_' || c || '(x)");' AS line7,
      '    return item_' || (c % 10) || '(a).value;' AS line8 FROM orows),
  osym AS (
    SELECT project_id, file_uri, k, c, '0' AS path, 1 AS depth, cname AS name, 5 AS kind, header AS detail, '2:0-11:1' AS rng, '2:6-2:10' AS sel,
      NULL::VARCHAR AS parent_name, 'class' AS prefix, ''::VARCHAR AS body FROM okrows
    UNION ALL SELECT project_id, file_uri, k, c, '0.0', 2, 'item_' || (c % 10), 8, '', '3:2-3:40', '3:8-3:20', cname, 'field', '' FROM okrows
    UNION ALL SELECT project_id, file_uri, k, c, '0.1', 2, 'load_' || third, 6, load_decl, '5:2-9:3', '5:14-5:20', cname, 'method',
      load_decl || ' {' || chr(10) || line6 || chr(10) || line7 || chr(10) || line8 || chr(10) || '  }' FROM okrows
    UNION ALL SELECT project_id, file_uri, k, c, '0.1.0', 3, 'inner_' || (k % 3), 12, '', '6:4-6:39', '6:4-6:6', 'load_' || third, 'func',
      'if (a.isEmpty) { return new Box(a);' FROM okrows WHERE k % 4 = 0
    UNION ALL SELECT project_id, file_uri, k, c, '0.2', 2, 'send_' || k, 6, '', '10:2-10:' || (length(send_line) + 1), '10:7-10:12', cname, 'method',
      substring(send_line, 3) FROM okrows
    UNION ALL SELECT project_id, file_uri, k, c, '0.3', 2, cname, 9, '', '2:0-2:0', '2:0-2:1', cname, 'ctor', '' FROM okrows),
  oid AS (SELECT *, file_uri || CASE WHEN parent_name IS NULL THEN '' ELSE '#parent:' || parent_name END || '#kind:' || prefix || '#name:'
      || CASE kind WHEN 9 THEN '_default_' ELSE name END AS node_id,
      CASE WHEN k % 3 = 0 THEN 'Set<' ELSE 'final List<' END || parent_name || '>' AS item_type FROM osym),
  mention AS (
    SELECT project_id, node_id AS source, unnest(['load_' || (k // 3), 'if', 'Box', 'emit', 'load_' || (k // 2 // 3), 'track', 'item_' || (c % 10)]) AS name
      FROM oid WHERE path = '0.1'
    UNION SELECT project_id, node_id, unnest(['if', 'Box']) FROM oid WHERE path = '0.1.0'
    UNION SELECT project_id, node_id, unnest(['send_' || k, 'load_' || (k // 3), 'hub.send_' || (k // 2), 'send_' || (k // 2)]) FROM oid WHERE path = '0.2'),
  calls AS (SELECT DISTINCT m.project_id, m.source, t.node_id AS target, 'CALLS' AS label FROM mention m
    JOIN oid t ON t.project_id = m.project_id AND t.name = m.name AND t.kind IN (6, 12) WHERE m.source <> t.node_id),
  orefs AS (SELECT k, unnest([k, k // 2]) AS user_k FROM orows),
  reads AS (SELECT DISTINCT t.project_id, s.node_id AS source, t.node_id AS target, 'READS_FROM' AS label
    FROM orefs r JOIN oid t ON t.k = r.k AND t.path = '0.0' JOIN oid s ON s.k = r.user_k AND s.path = '0.1' AND s.project_id = t.project_id
    WHERE t.name = 'item_' || (s.c % 10)),
  heads AS (SELECT project_id, name, first(node_id ORDER BY file_uri) AS node_id FROM oid WHERE kind = 5 GROUP BY ALL),
  inherits AS (SELECT DISTINCT o.project_id, o.node_id AS source, h.node_id AS target, 'EXTENDS' AS label FROM oid o
    JOIN heads h ON h.project_id = o.project_id AND h.name = 'Base' || ((o.c + 1) % 9) WHERE o.kind = 5 AND o.node_id <> h.node_id),
  core AS (SELECT * FROM calls UNION ALL SELECT * FROM reads UNION ALL SELECT * FROM inherits),
  packs AS (SELECT DISTINCT project_id, folder FROM orows WHERE folder < 9),
  onode AS (SELECT project_id, node_id, CASE prefix WHEN 'func' THEN 'function' WHEN 'ctor' THEN 'constructor' ELSE prefix END AS kind,
      CASE WHEN kind = 5 THEN 'service' ELSE 'member' END AS layer, CASE WHEN k % 10 < 9 THEN 'pkg_f' || (k % 10) END AS package,
      CASE WHEN k % 10 = 9 OR k % 10 % 2 = 0 THEN 'project' ELSE 'external_package' END AS source_type FROM oid
    UNION ALL SELECT project_id, 'package_container:pkg_f' || folder, 'package_container', 'utility', 'pkg_f' || folder, 'external_package' FROM packs
    UNION ALL SELECT DISTINCT project_id, 'project_root', 'package_container', 'utility', NULL, 'project' FROM packs),
  deps AS (SELECT DISTINCT e.project_id, CASE WHEN s.package IS NULL THEN 'project_root' ELSE 'package_container:' || s.package END AS source,
      'package_container:' || t.package AS target, 'USES_AS_TYPE' AS label
    FROM core e JOIN onode s ON s.node_id = e.source JOIN onode t ON t.node_id = e.target
    WHERE t.package IS NOT NULL AND (s.package IS NULL OR s.package <> t.package)),
  alledges AS (SELECT * FROM core UNION ALL SELECT * FROM deps)"""

# --- supplier package manifests ------------------------------------------------------
MANIFEST = """man AS (
    SELECT s_suppkey AS k, s_nationkey AS n, 's' || s_suppkey AS project_id, unnest([
      {'o': 0, 'name': 'http_' || s_suppkey, 'uri': 'file:///pub/http_' || s_suppkey, 'path': '/pub/http_' || s_suppkey, 'v': '1.' || (s_suppkey % 9)},
      {'o': 1, 'name': 'own_' || s_suppkey, 'uri': '../modules/./own_' || s_suppkey || '/', 'path': '/work/s' || s_suppkey || '/modules/own_' || s_suppkey, 'v': 'unknown'},
      {'o': 2, 'name': 'flutter', 'uri': 'file:///sdk/flutter', 'path': '/sdk/flutter', 'v': '3'},
      {'o': 4, 'name': 'dev_' || s_suppkey, 'uri': 'file:///pub/dev%20' || s_suppkey, 'path': '/pub/dev ' || s_suppkey, 'v': 'unknown'},
      {'o': 6, 'name': 'core_' || s_suppkey, 'uri': 'file:///opt/dart-sdk/pkg/' || s_suppkey, 'path': '/opt/dart-sdk/pkg/' || s_suppkey, 'v': 'unknown'},
      {'o': 7, 'name': 'path_' || s_suppkey, 'uri': 'file:///other/path_' || s_suppkey, 'path': '/other/path_' || s_suppkey, 'v': 'unknown'},
      {'o': 8, 'name': 'c++(' || s_suppkey, 'uri': 'file:///odd/cpp', 'path': '/odd/cpp', 'v': 'unknown'},
      {'o': 9, 'name': 'a.b+' || s_suppkey, 'uri': 'file:///odd/dots', 'path': '/odd/dots', 'v': 'unknown'},
      {'o': 10, 'name': 'flutter_' || s_nationkey, 'uri': 'file:///pub/fl', 'path': '/pub/fl', 'v': 'unknown'}]) AS p, s_name FROM supplier),
  typed AS (SELECT *, CASE WHEN p.o IN (1, 7) OR (p.o IN (4, 8) AND k % 2 = 0) THEN 'custom' WHEN p.o IN (2, 10) THEN 'flutter_official' WHEN p.o = 6 THEN 'sdk' ELSE 'third_party' END AS type FROM man)"""
