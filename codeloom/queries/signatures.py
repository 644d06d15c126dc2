"""Queries over part classes and their order-line members: identity, declarations, layers."""

from pyspark.sql import functions as F

from codeloom.functions import signatures as sig
from codeloom.functions import symbols as S
from codeloom.functions.text import base_type_name
from codeloom.operators import edges as E, enrich as R, nodes as N
from codeloom.plans import bindings as B
from codeloom.plans.sql import PART_LAKE, SIGNATURE_PARAMS


def kind_names(spark, d):
    kind = (F.col("l_suppkey") % 25).cast("int")
    return B.table(spark, d, "lineitem").select(kind.alias("code")).groupBy("code").agg(F.count("*").alias("n")).select(
        "code", S.kind_name(F.col("code")).alias("kind"), S.kind_prefix(F.col("code")).alias("prefix"), "n")


def _members(spark, d):
    """Members with their ids, parent ids and order."""
    uri, name, kind = F.col("file_uri"), F.col("name"), F.col("kind")
    none = F.lit(None).cast("string")
    return B.part_members(spark, d).select(
        "*", S.node_id(uri, name, kind, F.col("parent_name")).alias("node_id"), S.symbol_uid(uri, name, kind).alias("symbol_uid"),
        S.node_id(uri, F.col("parent_name"), F.col("parent_kind"), none).alias("parent_node_id"),
        F.struct("file_uri", "sym_path").alias("ord"))


def _classes(spark, d):
    uri, name, kind = F.col("file_uri"), F.col("name"), F.col("kind")
    none = F.lit(None).cast("string")
    return B.part_classes(spark, d).select(
        "*", S.node_id(uri, name, kind, none).alias("node_id"), S.symbol_uid(uri, name, kind).alias("symbol_uid"),
        none.alias("parent_node_id"), F.struct("file_uri", "sym_path").alias("ord"))


def node_ids(spark, d):
    return _members(spark, d).groupBy("project_id", "node_id", "symbol_uid").agg(F.count("*").alias("n_symbols"))


def access_flags(spark, d):
    flags = [S.access(F.col("name")).alias("access"), S.is_sdk_uri(F.col("file_uri")).alias("is_sdk")]
    return _members(spark, d).groupBy("project_id", *flags).agg(F.count("*").alias("n"))


def relevant_symbols(spark, d):
    name, kind = F.col("name"), F.col("kind")
    members = B.part_members(spark, d).select("project_id", "name", "kind")
    every = members.unionByName(B.part_classes(spark, d).select("project_id", "name", "kind"))
    return every.groupBy("project_id", S.is_relevant(name, kind).alias("relevant"),
                         S.is_relevant_top_level(name, kind).alias("top_level")).agg(F.count("*").alias("n"))


def executable_symbols(spark, d):
    return E.executables(_members(spark, d)).groupBy("project_id", "kind").agg(F.count("*").alias("n"))


def node_projection(spark, d):
    null_rng = F.lit(None).cast("struct<sl:int,sc:int,el:int,ec:int>")
    rows = _members(spark, d).withColumn("layer", F.lit("member")).withColumn("rng", null_rng).withColumn("sel_rng", null_rng)
    return N.first_wins(N.node_rows(rows), ["project_id", "node_id"], "ord").select(
        "project_id", "node_id", "label", "kind", "access", "is_sdk", "layer", "parent")


def first_details(spark, d):
    rows = _members(spark, d).select("project_id", "node_id", "ord", "detail")
    return N.first_wins(rows, ["project_id", "node_id"], "ord").select("project_id", "node_id", "detail")


def last_details(spark, d):
    rows = _members(spark, d).select("project_id", "node_id", "ord", "detail")
    return N.last_wins(rows, ["project_id", "node_id"], "ord").select("project_id", "node_id", "detail")


def name_index(spark, d):
    return N.name_index(_members(spark, d))


def index_entries(spark, d):
    return N.index_entries(_members(spark, d)).select("project_id", "name", "node_id", F.element_at("first.sym_path", 2).alias("first_order"))


def _returns(spark, d):
    callables = _members(spark, d)
    plain = callables.filter(F.col("kind").isin(6, 12))
    return plain.withColumn("return_type", sig.return_type(F.col("detail"), F.col("name")))


def member_features(spark, d):
    members = _members(spark, d).withColumn("parent_key", F.col("parent_node_id")).withColumn(
        "return_type", F.when(F.col("kind").isin(6, 12), sig.return_type(F.col("detail"), F.col("name"))))
    return N.member_features(members).withColumnRenamed("parent_key", "node_id")


def layers(spark, d):
    cols = ["project_id", "key", "parent_key", "name", "kind", "detail", "return_type", "bases"]
    members = _members(spark, d).select(
        "project_id", F.col("node_id").alias("key"), F.col("parent_node_id").alias("parent_key"), "name", "kind", "detail",
        F.when(F.col("kind").isin(6, 12), sig.return_type(F.col("detail"), F.col("name"))).alias("return_type"),
        F.lit(None).cast("array<string>").alias("bases"))
    classes = R.attach_relations(_classes(spark, d)).select(
        "project_id", F.col("node_id").alias("key"), F.col("parent_node_id").alias("parent_key"), "name", "kind", "detail",
        F.lit(None).cast("string").alias("return_type"), sig.lowered_relations(F.col("relations")).alias("bases"))
    both = N.with_layers(members.unionByName(classes).select(*cols))
    return both.groupBy("project_id", F.col("key").alias("node_id"), "layer").agg(F.count("*").alias("n"))


def field_types(spark, d):
    return _members(spark, d).filter(sig.is_field(F.col("kind"))).select(
        "project_id", "symbol_uid", sig.field_type(F.col("detail")).alias("resolved_type"))


def return_types(spark, d):
    return _returns(spark, d).select("project_id", "node_id", "return_type")


def parameters(spark, d):
    known = R.detail_evidence(_members(spark, d)).withColumn("params", F.col("detail_params"))
    return R.param_rows(known).select(
        "project_id", "node_id", "pos", "name", "type", "is_named", "is_required", "is_optional_positional")


def own_field_params(spark, d):
    known = R.detail_evidence(_members(spark, d)).withColumn("params", F.col("detail_params")).withColumn(
        "resolved_type", F.col("detail_type"))
    ctor = R.param_rows(known.filter(F.col("kind") == 9))
    return R.resolve_own_fields(ctor, known).select("project_id", "node_id", "pos", "name", "type")


def class_relations(spark, d):
    classes = R.attach_relations(_classes(spark, d).filter(F.col("kind") == 5))
    rows = classes.select("project_id", "symbol_uid", F.explode(sig.relation_rows(F.col("relations"))).alias("r"))
    return rows.select("project_id", "symbol_uid", "r.*")


def inheritance_edges(spark, d):
    classes = R.attach_relations(_classes(spark, d).filter(F.col("kind") == 5))
    relations = classes.select(
        "project_id", F.col("node_id").alias("source"), F.explode(sig.relation_rows(F.col("relations"))).alias("r"),
    ).select("project_id", "source", "r.*")
    nodes = classes.select("project_id", "node_id", F.col("name").alias("label"), F.lit("class").alias("kind"), "ord")
    return E.relation_edges(relations, nodes)


def resolved_types(spark, d):
    uses = _members(spark, d).filter(sig.is_field(F.col("kind"))).select(
        "project_id", "node_id", sig.field_type(F.col("detail")).alias("type"))
    found = R.resolve_types(uses, _definitions(spark, d), "type", "ref")
    return found.select("project_id", "node_id", "type", F.col("ref.definition.file_uri").alias("defined_in"),
                        F.col("ref.definition.kind").alias("defined_kind"))


def _definitions(spark, d):
    return R.type_definitions(_classes(spark, d).withColumn("sel_rng", F.lit(None).cast("int")))


def resolved_params(spark, d):
    """Parameter types with their definitions; own-field parameters keep only their name."""
    known = R.detail_evidence(_members(spark, d)).withColumn("params", F.col("detail_params"))
    uses = R.param_rows(known).select("project_id", "node_id", "pos", "type")
    return R.resolve_types(uses, _definitions(spark, d), "type", "ref").select(
        "project_id", "node_id", "pos", F.col("ref.name").alias("type"), F.col("ref.definition.file_uri").alias("defined_in"))


def resolved_returns(spark, d):
    uses = _returns(spark, d).select("project_id", "node_id", F.col("return_type").alias("type"))
    return R.resolve_types(uses, _definitions(spark, d), "type", "ref").select(
        "project_id", "node_id", F.col("ref.name").alias("type"), F.col("ref.definition.file_uri").alias("defined_in"))


# fixed values: type texts wrapped around a key
TYPE_SHAPES = ["int", " User{k}? ", "List<Item{k}>", "Map<String, Item{k}>", "Map<String, List<Item{k}>>", "p.Type<X>",
               "List<Set<lib.Item{k}?>?>", "final Item{k}", "", "Future <Deep<Deeper<D{k}>> >"]
TYPE_BASES = ["int", "User{k}", "Item{k}", "Item{k}", "List<Item{k}>", "Type<X>", "Item{k}", "Item{k}", None, "D{k}"]


def base_type_names(spark, d):
    key = F.col("l_orderkey")
    shape = F.replace(B.pick(TYPE_SHAPES, key + F.col("l_linenumber")), F.lit("{k}"), key.cast("string"))
    return B.table(spark, d, "lineitem").select(shape.alias("type_text")).select(
        "type_text", base_type_name(F.col("type_text")).alias("base_name")).groupBy("type_text", "base_name").agg(
        F.count("*").alias("n"))


_FEATURES = f"""{PART_LAKE},
  returned AS (SELECT *, CASE WHEN kind IN (6, 12) THEN CASE rtype WHEN 'void' THEN NULL WHEN 'static int' THEN 'int' ELSE rtype END END AS return_type FROM ids),
  flags AS (SELECT project_id, parent_id, kind IN (7, 8) AS f, kind = 6 AS m, name, lower(name) AS lname,
      lower(coalesce(return_type, '')) AS ret, lower(detail) AS det FROM returned),
  features AS (SELECT project_id, parent_id AS node_id,
      count(*) FILTER (f) AS fields, count(*) FILTER (m) AS methods, count(*) FILTER (m AND name = 'build') AS build_methods,
      count(*) FILTER (m AND name IN ('add', 'emit', 'on')) AS event_methods,
      count(*) FILTER (f AND name IN ('stream', 'state')) AS state_fields,
      count(*) FILTER (m AND (contains(ret, 'future') OR contains(ret, 'stream') OR contains(lname, 'async'))) AS async_methods,
      count(*) FILTER (m AND lname NOT IN ('hashcode', 'operator==')) AS business_methods
    FROM flags GROUP BY project_id, parent_id)"""

_RELATIONS = """rels AS (
    SELECT c.project_id, c.file_uri, c.name, c.kind, c.part, 'extends' AS rel_kind, 0 AS ord, c.base AS target_name FROM classes c WHERE kind = 5 AND declared
    UNION ALL SELECT project_id, file_uri, name, kind, part, 'with', i, m FROM classes, (VALUES (0, 'MixA'), (1, 'MixB<int, String>')) v(i, m) WHERE kind = 5 AND declared AND mixed
    UNION ALL SELECT project_id, file_uri, name, kind, part, 'implements', 0, port FROM classes WHERE kind = 5 AND declared AND port IS NOT NULL
    UNION ALL SELECT project_id, file_uri, name, kind, part, 'implements', 1, 'Shape3' FROM classes WHERE kind = 5 AND declared AND port IS NOT NULL)"""

_CLASS_ID = "file_uri || '#kind:' || CASE kind WHEN 5 THEN 'class' ELSE 'enum' END || '#name:' || name"

_LAYERS_SQL = f"""WITH {_FEATURES}, {_RELATIONS},
  bases AS (SELECT part, list(string_split(lower(target_name), '<')[1]) AS bs FROM rels GROUP BY part),
  c AS (SELECT c.project_id, {_CLASS_ID} AS node_id, lower(c.name) AS n, c.kind, coalesce(b.bs, []::VARCHAR[]) AS bs FROM classes c LEFT JOIN bases b USING (part)),
  j AS (SELECT c.*, array_to_string(bs, '|') AS bj, coalesce(fields, 0) AS fields, coalesce(methods, 0) AS methods, coalesce(build_methods, 0) AS bm,
      coalesce(event_methods, 0) AS em, coalesce(state_fields, 0) AS sf, coalesce(async_methods, 0) AS am, coalesce(business_methods, 0) AS bz
    FROM c LEFT JOIN features f ON f.project_id = c.project_id AND f.node_id = c.node_id),
  done AS (SELECT project_id, node_id, CASE
    WHEN list_has_any(bs, ['statelesswidget','statefulwidget','hookwidget','widget']) THEN 'view'
    WHEN kind = 5 AND bm > 0 THEN 'view'
    WHEN regexp_matches(bj, 'widget|component|renderobject|sliver') THEN 'view'
    WHEN regexp_matches(n, '(page|screen|view|widget|dialog|modal|bottomsheet|drawer)$') THEN 'view'
    WHEN regexp_matches(n, 'page|screen|widget|dialog') THEN 'view'
    WHEN list_has_any(bs, ['changenotifier','statenotifier','bloc','cubit','provider','controller']) THEN 'state'
    WHEN kind = 5 AND sf > 0 AND em > 0 THEN 'state'
    WHEN regexp_matches(n, '(bloc|cubit|provider|controller|manager|viewmodel|notifier|store|reducer|state)$') THEN 'state'
    WHEN regexp_matches(n, 'bloc|cubit|provider|controller|notifier|state') THEN 'state'
    WHEN kind = 5 AND methods > 0 AND am / methods >= 0.5 THEN 'service'
    WHEN regexp_matches(bj, 'service|repository|client|adapter|gateway') THEN 'service'
    WHEN regexp_matches(n, '(service|repository|api|datasource|client|gateway|adapter|helper|manager|handler)$') THEN 'service'
    WHEN regexp_matches(n, 'service|repository|api|client|gateway|adapter') THEN 'service'
    WHEN kind = 5 AND fields > 0 AND bz <= 2 THEN 'model'
    WHEN regexp_matches(n, '(model|entity|dto|data|response|request|event|state|vo|pojo)$') THEN 'model'
    WHEN regexp_matches(n, 'model|entity|dto|data') THEN 'model'
    WHEN kind = 10 THEN 'model' ELSE 'utility' END AS layer FROM j
    UNION ALL SELECT project_id, node_id, 'member' FROM ids)
  SELECT project_id, node_id, layer, count(*) AS n FROM done GROUP BY ALL"""


def _type_case() -> str:
    def sql(t):
        return "NULL" if t is None else "'" + t.replace("{k}", "' || l_orderkey || '") + "'"
    n = len(TYPE_SHAPES)
    both = [f"WHEN {i} THEN {{}}" for i in range(n)]
    texts = " ".join(w.format(sql(t)) for w, t in zip(both, TYPE_SHAPES))
    bases = " ".join(w.format(sql(t)) for w, t in zip(both, TYPE_BASES))
    at = f"(l_orderkey + l_linenumber) % {n}"
    return f"""SELECT type_text, base_name, count(*) AS n FROM (SELECT CASE {at} {texts} END AS type_text,
        CASE {at} {bases} END AS base_name FROM lineitem) GROUP BY ALL"""


_ORDER = "ok, ln, sk, cents"
_EXCLUDED = "toString|hashCode|operator|runtimeType|noSuchMethod|now|parse|tryParse"

QUERIES = {
    "kind_names": (kind_names, """SELECT (l_suppkey % 25)::INT AS code, CASE l_suppkey % 25 WHEN 3 THEN 'namespace' WHEN 5 THEN 'class' WHEN 6 THEN 'method'
          WHEN 7 THEN 'property' WHEN 8 THEN 'field' WHEN 9 THEN 'constructor' WHEN 10 THEN 'enum' WHEN 12 THEN 'function'
          WHEN 22 THEN 'typedef' ELSE 'kind_' || (l_suppkey % 25) END AS kind,
        CASE l_suppkey % 25 WHEN 3 THEN 'ext' WHEN 5 THEN 'class' WHEN 6 THEN 'method' WHEN 7 THEN 'prop' WHEN 8 THEN 'field'
          WHEN 9 THEN 'ctor' WHEN 10 THEN 'enum' WHEN 12 THEN 'func' WHEN 22 THEN 'typedef' ELSE 'k' || (l_suppkey % 25) END AS prefix,
        count(*) AS n FROM lineitem GROUP BY ALL"""),
    "node_ids": (node_ids, f"WITH {PART_LAKE} SELECT project_id, node_id, symbol_uid, count(*) AS n_symbols FROM ids GROUP BY ALL"),
    "access_flags": (access_flags, f"""WITH {PART_LAKE} SELECT project_id, CASE WHEN starts_with(name, '_') THEN 'private' ELSE 'public' END AS access,
        contains(file_uri, '/dart-sdk/lib/') AS is_sdk, count(*) AS n FROM ids GROUP BY ALL"""),
    "relevant_symbols": (relevant_symbols, f"""WITH {PART_LAKE}, every AS (SELECT project_id, name, kind FROM members UNION ALL SELECT project_id, name, kind FROM classes)
        SELECT project_id, NOT starts_with(name, '_') AND (kind IN (5, 10) OR (kind IN (6, 12) AND NOT regexp_matches(name, '{_EXCLUDED}'))) AS relevant,
          kind IN (5, 10, 12) AND NOT starts_with(name, '_') AND length(name) > 2 AS top_level, count(*) AS n FROM every GROUP BY ALL"""),
    "executable_symbols": (executable_symbols, f"WITH {PART_LAKE} SELECT project_id, kind, count(*) AS n FROM members WHERE kind IN (6, 9, 12) GROUP BY ALL"),
    "node_projection": (node_projection, f"""WITH {PART_LAKE} SELECT DISTINCT project_id, node_id, name AS label,
        CASE kind WHEN 9 THEN 'constructor' WHEN 6 THEN 'method' WHEN 12 THEN 'function' WHEN 8 THEN 'field' ELSE 'property' END AS kind,
        CASE WHEN starts_with(name, '_') THEN 'private' ELSE 'public' END AS access, contains(file_uri, '/dart-sdk/lib/') AS is_sdk,
        'member' AS layer, parent_id AS parent FROM ids"""),
    "first_details": (first_details, f"WITH {PART_LAKE} SELECT project_id, node_id, first(detail ORDER BY {_ORDER}) AS detail FROM ids GROUP BY project_id, node_id"),
    "last_details": (last_details, f"""WITH {PART_LAKE} SELECT project_id, node_id,
        first(detail ORDER BY ok DESC, ln DESC, sk DESC, cents DESC) AS detail FROM ids GROUP BY project_id, node_id"""),
    "name_index": (name_index, f"""WITH {PART_LAKE} SELECT project_id, name, count(*) AS n_symbols,
        first(node_id ORDER BY file_uri, l_partkey, {_ORDER}) AS first_id FROM ids GROUP BY project_id, name"""),
    "index_entries": (index_entries, f"""WITH {PART_LAKE} SELECT project_id, name, node_id, first(ok ORDER BY file_uri, l_partkey, {_ORDER}) AS first_order
        FROM ids GROUP BY project_id, name, node_id"""),
    "member_features": (member_features, f"WITH {_FEATURES} SELECT * FROM features"),
    "layers": (layers, _LAYERS_SQL),
    "field_types": (field_types, f"WITH {PART_LAKE} SELECT project_id, symbol_uid, ftype AS resolved_type FROM ids WHERE kind IN (7, 8)"),
    "return_types": (return_types, f"""WITH {PART_LAKE} SELECT project_id, node_id,
        CASE rtype WHEN 'void' THEN NULL WHEN 'static int' THEN 'int' ELSE rtype END AS return_type FROM ids WHERE kind IN (6, 12)"""),
    "parameters": (parameters, f"""WITH {PART_LAKE}, {SIGNATURE_PARAMS}
        SELECT i.project_id, i.node_id, p.pos, p.name, p.type, p.is_named, p.is_required, p.is_optional AS is_optional_positional
        FROM ids i JOIN params p USING (shape) WHERE i.kind = 9 OR (i.kind IN (6, 12) AND i.shape <> 11)"""),
    "own_field_params": (own_field_params, f"""WITH {PART_LAKE}, {SIGNATURE_PARAMS},
        firsts AS (SELECT project_id, parent_id, name AS field, first(ftype ORDER BY {_ORDER}) AS field_type FROM ids WHERE kind IN (7, 8) GROUP BY ALL)
        SELECT i.project_id, i.node_id, p.pos, p.name, CASE WHEN starts_with(p.type, 'self_field:') THEN coalesce(f.field_type, p.type) ELSE p.type END AS type
        FROM ids i JOIN params p USING (shape) LEFT JOIN firsts f ON f.project_id = i.project_id AND f.parent_id = i.parent_id AND 'self_field:' || f.field = p.type
        WHERE i.kind = 9"""),
    "class_relations": (class_relations, f"""WITH {PART_LAKE}, {_RELATIONS}
        SELECT project_id, file_uri || '#' || name || '#' || kind AS symbol_uid, rel_kind, ord, target_name FROM rels"""),
    "inheritance_edges": (inheritance_edges, f"""WITH {PART_LAKE}, {_RELATIONS},
        firsts AS (SELECT project_id, name AS label, first({_CLASS_ID} ORDER BY file_uri, part) AS class_id FROM classes WHERE kind = 5 GROUP BY ALL)
        SELECT DISTINCT r.project_id, {_CLASS_ID} AS source, f.class_id AS target, upper(r.rel_kind) AS label
        FROM rels r JOIN firsts f ON f.project_id = r.project_id AND f.label = trim(string_split(r.target_name, '<')[1])
        WHERE rel_kind IN ('extends', 'implements')"""),
    "resolved_types": (resolved_types, f"""WITH {PART_LAKE},
        defs AS (SELECT project_id, name, first(file_uri ORDER BY file_uri, part) AS defined_in, first(kind ORDER BY file_uri, part) AS defined_kind FROM classes GROUP BY ALL)
        SELECT i.project_id, i.node_id, i.ftype AS type, d.defined_in, d.defined_kind FROM ids i LEFT JOIN defs d ON d.project_id = i.project_id
          AND d.name = CASE i.ftype WHEN 'int' THEN 'int' WHEN 'List<int>' THEN 'int' WHEN 'Map<String, Shape1>' THEN 'Shape1' WHEN 'Shape2?' THEN 'Shape2'
            WHEN 'Shape3' THEN 'Shape3' ELSE 'Shape0' END
        WHERE i.kind IN (7, 8)"""),
    "resolved_params": (resolved_params, f"""WITH {PART_LAKE}, {SIGNATURE_PARAMS},
        defs AS (SELECT project_id, name, first(file_uri ORDER BY file_uri, part) AS defined_in FROM classes GROUP BY ALL),
        used AS (SELECT i.project_id, i.node_id, p.pos, p.type, CASE p.type WHEN 'List<int>' THEN 'int' WHEN 'Map<String, List<Shape1>>' THEN 'List<Shape1>'
            WHEN 'Foo<Bar>' THEN 'Bar' WHEN 'final int' THEN 'int' ELSE p.type END AS base
          FROM ids i JOIN params p USING (shape) WHERE i.kind = 9 OR (i.kind IN (6, 12) AND i.shape <> 11))
        SELECT u.project_id, node_id, pos, type, defined_in FROM used u LEFT JOIN defs d ON d.project_id = u.project_id AND d.name = u.base"""),
    "resolved_returns": (resolved_returns, f"""WITH {PART_LAKE},
        defs AS (SELECT project_id, name, first(file_uri ORDER BY file_uri, part) AS defined_in FROM classes GROUP BY ALL),
        used AS (SELECT project_id, node_id, CASE rtype WHEN 'void' THEN NULL WHEN 'static int' THEN 'int' ELSE rtype END AS type,
            CASE rtype WHEN 'Stream<Shape1>' THEN 'Shape1' WHEN 'List<Shape3>' THEN 'Shape3' WHEN 'Future<int>' THEN 'int' WHEN 'static int' THEN 'int'
              WHEN 'void' THEN NULL ELSE rtype END AS base FROM ids WHERE kind IN (6, 12))
        SELECT u.project_id, node_id, type, defined_in FROM used u LEFT JOIN defs d ON d.project_id = u.project_id AND d.name = u.base"""),
    "base_type_names": (base_type_names, _type_case()),
}
