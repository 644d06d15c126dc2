"""Adapters that read the analytics tables as code-graph inputs.

Each adapter maps rows to nodes, edges, symbols or files one by one; none groups a table by hand
and none leaves rows out, but for `order_packages`, which leaves one folder in ten without a package.
Every derived text is a function of its own row.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Key columns dealt over the shuffle partitions before long texts are derived from them.

    Only these narrow rows move. A table may be one row group, which one task would read and write out at length.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text(*parts) -> Column:
    """Concatenate literals and columns; numbers are shown as text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


# --- the trade graph: customers, suppliers and parts as nodes, order lines as edges ---
TRADE = "trade"
_LAYERS = ["view", "state", "service", "model", "utility"]
_TRADE_LABELS = ["CALLS", "INSTANCE_OF", "USES_AS_TYPE", "READS_FROM", "WRITES_TO"]
_PART_SUFFIX = ["Dialog", "Formatter", "Analytics", "SnackBar", "", "", "", ""]


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, node_id, ord, label, kind, layer, parent, rel_path, package."""
    def row(kind, key, rank, label, layer, parent, rel_path, package):
        return [
            F.lit(TRADE).alias("project_id"), text(f"{kind}:", key).alias("node_id"),
            F.struct(F.lit(rank).alias("rank"), key.cast("bigint").alias("key")).alias("ord"),
            label.alias("label"), F.lit("method" if kind == "part" else "class" if rank > 2 else "folder").alias("kind"),
            layer.alias("layer"), parent.cast("string").alias("parent"), rel_path.alias("rel_path"),
            package.cast("string").alias("package"),
        ]
    none, util = F.lit(None), F.lit("utility")
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    places = nations.join(regions, nations.n_regionkey == regions.r_regionkey).select(
        "n_nationkey", F.lower(text("lib/", F.col("r_name"), "/", F.col("n_name"))).alias("place"))
    cust = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    supp = table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    part = table(spark, sf_dir, "part")
    c, s, p = F.col("c_custkey"), F.col("s_suppkey"), F.col("p_partkey")
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    return reduce(DataFrame.unionByName, [
        regions.select(*row("region", F.col("r_regionkey"), 1, F.col("r_name"), util, none,
                            F.lower(text("lib/", F.col("r_name"))), none)),
        nations.select(*row("nation", F.col("n_nationkey"), 2, F.col("n_name"), util,
                            text("region:", F.col("n_regionkey")), F.lower(text("lib/", F.col("n_name"))), none)),
        cust.select(*row("customer", c, 3, F.col("c_name"), pick(_LAYERS, c), text("nation:", F.col("c_nationkey")),
                         text(F.col("place"), "/customer_", c, ".dart"), none)),
        supp.select(*row("supplier", s, 4, F.col("s_name"), pick(_LAYERS, s + 1), text("nation:", F.col("s_nationkey")),
                         text(F.col("place"), "/supplier_", s, ".dart"), text("supply_", F.col("s_nationkey")))),
        part.select(*row("part", p, 5, text(F.col("p_name"), pick(_PART_SUFFIX, p)), pick(_LAYERS, p), none,
                         text("packages/", brand, "/part_", p, ".dart"), brand)),
    ])


def trade_edges(spark: SparkSession, sf_dir: str, by_source: bool = False) -> DataFrame:
    """project_id, edge_ord, source, target, label; each (source, target, label) once.

    With `by_source` the edges lie by the name of their source, so that a join on it needs no exchange of its own.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    customer, part, supplier = (F.col(c).cast("bigint") for c in ("o_custkey", "l_partkey", "l_suppkey"))
    use = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)

    def pair(source: Column, target: Column, kind: Column) -> Column:
        return F.struct(kind.cast("tinyint").alias("kind"), source.alias("source"), target.alias("target"))
    pairs = F.array(pair(customer, part, use), pair(part, supplier, F.lit(3)), pair(supplier, customer, F.lit(4)))
    kind = F.col("kind")

    def name(side: str, read: str, write: str) -> Column:
        key = F.col(side)
        return F.when(kind == 3, text(f"{read}:", key)).when(kind == 4, text(f"{write}:", key)).otherwise(
            text("customer:" if side == "source" else "part:", key))
    source, target = name("source", "part", "supplier"), name("target", "supplier", "customer")
    # repeats are folded by their numbers, which alone move; names and labels are told of the edges that are left
    offered = rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"), F.explode(pairs).alias("e")).select("at", "e.*")
    keys = ["kind", "source", "target"]
    if by_source:
        offered, keys = offered.repartition(source).withColumn("source_id", source), [*keys, "source_id"]
    edges = offered.groupBy(*keys).agg(F.min("at").alias("edge_ord"))
    return edges.select(
        F.lit(TRADE).alias("project_id"), "edge_ord", (F.col("source_id") if by_source else source).alias("source"),
        target.alias("target"), pick(_TRADE_LABELS, kind).alias("label"))


# --- event walks ---------------------------------------------------------------------
def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User -> slot edges per event type, readers on even and writers on odd events."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("project_id"), F.col("event_id").alias("edge_ord"),
        text("n", F.col("user_id")).alias("source"), text("n", k).alias("target"),
        F.when(F.col("event_id") % 2 == 0, "READS_FROM").otherwise("WRITES_TO").alias("label"))


# --- part classes with order-line members (signatures, features, layers) --------------
CLASS_SUFFIX = [
    "Page", "ScreenKit", "Bloc", "StateBox", "Repository", "ApiHub", "Model", "DataSet", "Utils", "Thing",
    "Drawer", "Handler", "Notifier", "Vo", "Mixin", "Widgetry", "Store", "Gateway", "Event", "Entity",
    "Config", "Dialogs", "Clientele", "Plain",
]
BASES = ["StatelessWidget", "ChangeNotifier", "Base", "BaseClient", "Gadget", "Component", "Odd", "Bloc"]
METHOD_NAMES = ["build", "add", "emit", "toString", "hashCode", "asyncLoad", "_hidden", "dispose"]
FIELD_NAMES = ["stream", "state", "qty", "price"]
FIELD_TYPES = ["int", "List<int>", "Map<String, Shape1>", "Shape2?", "Shape3", "p.Shape0"]
RETURN_TYPES = ["void", "Future<int>", "Stream<Shape1>", "static int", "String", "List<Shape3>"]
SIGNATURES = [
    "(int a, String b)",
    "({required this.qty, this.state = const [1, 2]})",
    "(Map<String, List<Shape1>> m, [int? n])",
    "(void Function(int, String) cb, {required Foo<Bar> x})",
    "()",
    "(qty)",
    "(List<int>)",
    "(final int a, covariant Base b,)",
    "(Map<A, B<C, D<E, F<G, H>>>> m, int z)",
    "({this.qty = const [[1, 2], [3]], int y = 2, required Map<int, Set<int>> k = const {1: {2, 3}, 4: {}}})",
    "(void Function(int Function(String Function(int, int), int)) cb, [int z = f(g(1, 2), 3)])",
    "({this.qty #, this.state})",
]


def _part_class(k: Column) -> dict[str, Column]:
    shape = text("Shape", k % 4)
    plain = text("C", k, pick(CLASS_SUFFIX, k))
    name = F.when(k % 9 == 0, shape).when(k % 13 == 0, F.concat(plain, F.lit("<T>"))).otherwise(plain)
    base = F.when(k % 8 == 2, text("Shape", k % 3, "<X, Y>")).otherwise(pick(BASES, k))
    detail = F.when(k % 3 == 0, "").otherwise(F.concat(
        F.lit("class "), name, F.lit(" extends "), base,
        F.when(k % 4 == 0, " with MixA, MixB<int, String>").otherwise(""),
        F.when(k % 5 == 0, text(" implements Repo", k % 6, "<T>, Shape3")).otherwise("")))
    return {"name": name, "detail": detail}


def part_uri(k: Column) -> Column:
    folder = F.when(k % 50 == 0, "file:///opt/dart-sdk/lib/").otherwise(
        text("file:///lake/", F.col("p_brand"), "/lib/", F.lower("p_type"), "/"))
    return F.concat(folder, text("part_", k, ".dart"))


def part_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    cls = _part_class(k)
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("project_id"), part_uri(k).alias("file_uri"), k.alias("part"),
        F.array(k).alias("sym_path"), F.lit(1).alias("depth"), cls["name"].alias("name"),
        F.when(F.col("p_size") % 10 == 0, 10).otherwise(5).alias("kind"), cls["detail"].alias("detail"))


def part_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One member symbol per order line, below the class of its part."""
    ok, ln, sk = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    lines = dealt(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"))
    owners = part_classes(spark, sf_dir).select(
        "project_id", "file_uri", "part", F.col("name").alias("parent_name"), F.col("kind").alias("parent_kind"))
    kind = (
        F.when(ln == 1, 9).when(ln.isin(2, 3, 7), 6).when(ln == 4, 12).when(ln == 5, 8).otherwise(7))
    name = (
        F.when((ln == 1) & (sk % 2 == 0), F.col("parent_name"))
        .when(ln == 1, F.concat("parent_name", F.lit(".named")))
        .when(ln == 2, text("ship_", sk)).when(ln == 3, pick(METHOD_NAMES, ok))
        .when(ln == 4, text("calc_", sk)).when(ln == 5, pick(FIELD_NAMES, ok))
        .when(ln == 6, text("prop_", ok % 5)).otherwise(text("ship_", sk + 1)))
    detail = (
        F.when(kind.isin(7, 8), F.concat(F.lit("@Doc late final "), pick(FIELD_TYPES, ok), F.lit(" "), F.col("name")))
        .when(kind == 9, pick(SIGNATURES, ok))
        .otherwise(F.concat(pick(RETURN_TYPES, sk), F.lit(" "), F.col("name"), pick(SIGNATURES, ok))))
    return (
        lines.join(owners, F.col("l_partkey") == F.col("part"))
        .withColumn("kind", kind).withColumn("name", name)
        .select(
            "project_id", "file_uri", "part",
            F.array(F.col("part"), ok, ln.cast("bigint"), sk, (F.col("l_extendedprice") * 100).cast("bigint")).alias("sym_path"),
            F.lit(2).alias("depth"), "name", "kind", detail.alias("detail"), "parent_name", "parent_kind",
            "l_orderkey", "l_linenumber", "l_suppkey")
    )


# --- one source file per order (trees, ranges, bodies, references) --------------------
def order_project(k: Column) -> Column:
    return text("p", F.floor(k / 60) % 20)


def order_uri(k: Column) -> Column:
    return text("file:///lake/", order_project(k), "/lib/f", k % 10, "/order_", k, ".dart")


def _order_cols() -> dict[str, Column]:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    third, half = F.floor(k / 3), F.floor(k / 2)
    name = F.when(k % 11 == 0, text("Base", c % 9)).otherwise(text("Order", k))
    load, send, item = text("load_", third), text("send_", k), text("item_", c % 10)
    header = F.concat(F.lit("class "), name, text(" extends Base", (c + 1) % 9, " implements Port", k % 4, "<int>"))
    load_decl = F.concat(F.lit("Future<int> "), load, F.lit("(int a, {required String b})"))
    send_line = F.concat(
        F.lit("  void "), send, F.lit("() { var s = 'ünï \U0001F600 '; await "), load,
        text("(1); hub.send_", half, "(); }"))
    lines = [
        text("import 'package:box_", c % 7, "/box.dart';"),
        text("import \"package:kit_", k % 5, "/kit.dart\"; // see http://x/", k),
        F.concat(header, F.lit(" {")),
        F.concat(F.lit("  final List<"), name, F.lit("> "), item, F.lit(";")),
        F.lit("  @override"),
        F.concat(F.lit("  "), load_decl, F.lit(" {")),
        text("    if (a.isEmpty) { return new Box(a); } /* skip_", c, "(1) */"),
        F.concat(text("    emit(load_", F.floor(half / 3)), F.lit("(a)); track(\""), text("send_", c, "(x)"), F.lit("\");")),
        F.concat(F.lit("    return "), item, F.lit("(a).value;")),
        F.lit("  }"),
        send_line,
        F.lit("}"),
    ]
    return {"name": name, "load": load, "send": send, "item": item, "header": header, "load_decl": load_decl,
            "content": reduce(lambda a, b: F.concat(a, F.lit("\n"), b), lines), "send_line": send_line}


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _orders(spark, sf_dir).select(
        order_project(k).alias("project_id"), order_uri(k).alias("file_uri"),
        text("lib/f", k % 10, "/order_", k, ".dart").alias("rel_path"), _order_cols()["content"].alias("content"))


def _rng(sl, sc, el, ec) -> Column:
    def pos(line, char):
        return F.struct(F.lit(line).cast("int").alias("line"), F.lit(char).cast("int").alias("character"))
    return F.struct(pos(sl, sc).alias("start"), pos(el, ec).alias("end"))


def order_trees(spark: SparkSession, sf_dir: str, failing: bool = False) -> DataFrame:
    """Symbol dump of every order file; on request some are empty and some failed."""
    k, x = F.col("o_orderkey"), _order_cols()

    def sym(name, detail, kind, rng, sel, children=None):
        cols = [name.alias("name"), detail.alias("detail"), F.lit(kind).alias("kind"),
                rng.alias("range"), sel.alias("selectionRange")]
        return F.struct(*cols, *([children.alias("children")] if children is not None else []))

    inner = sym(text("inner_", k % 3), F.lit(""), 12, _rng(6, 4, 6, 39), _rng(6, 4, 6, 6))
    # UTF-16 columns: the line holds one character outside the basic plane
    send_end = F.length(x["send_line"]) + 1
    members = F.array(
        F.to_json(sym(x["item"], F.lit(""), 8, _rng(3, 2, 3, 40), _rng(3, 8, 3, 20))),
        F.to_json(sym(x["load"], x["load_decl"], 6, _rng(5, 2, 9, 3), _rng(5, 14, 5, 20),
                      F.filter(F.array(inner), lambda _: k % 4 == 0))),
        F.to_json(sym(x["send"], F.lit(""), 6, _rng(10, 2, 10, send_end), _rng(10, 7, 10, 12))),
        # a constructor that the source does not write out
        F.to_json(sym(x["name"], F.lit(""), 9, _rng(2, 0, 2, 0), _rng(2, 0, 2, 1))),
    )
    whole = F.concat(
        F.lit("[{\"name\":\""), x["name"], F.lit("\",\"detail\":\""), x["header"],
        F.lit("\",\"kind\":5,\"range\":"), F.to_json(_rng(2, 0, 11, 1)),
        F.lit(",\"selectionRange\":"), F.to_json(_rng(2, 6, 2, 10)),
        F.lit(",\"children\":["), F.array_join(members, ","), F.lit("]}]"))
    status = F.when(k % 97 == 0, "error").when(k % 50 == 0, "empty").otherwise("ok") if failing else F.lit("ok")
    return _orders(spark, sf_dir).select(
        order_project(k).alias("project_id"), order_uri(k).alias("file_uri"), status.alias("status"),
        F.when(status == "error", "no answer").when(status == "empty", "[]").otherwise(whole).alias("tree"))


def order_hovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hover answers for the `send` methods and constructors, those of odd files empty, and for every third field."""
    k, x = F.col("o_orderkey"), _order_cols()

    def answer(line: int, char: int, when: Column, *shown) -> Column:
        said = F.array(F.concat(F.lit("```dart\n"), *shown, F.lit("\n```")), F.lit("docs"))
        return F.struct(F.lit(line).alias("line"), F.lit(char).alias("character"),
                        F.when(when, said).otherwise(F.array().cast("array<string>")).alias("contents"))
    answers = F.array(
        answer(10, 7, k % 2 == 0, F.lit("Future<Hub> "), x["send"], F.lit("()")),
        answer(2, 0, k % 2 == 0, x["name"], F.lit("({this."), x["item"], F.lit("})")),
        answer(3, 8, k % 3 == 0, F.lit("final Set<"), x["name"], F.lit("> "), x["item"]))
    return _orders(spark, sf_dir).select(
        order_project(k).alias("project_id"), order_uri(k).alias("file_uri"), F.explode(answers).alias("h")).select(
        "project_id", "file_uri", "h.*")


def order_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded references to the field of a file: from its own load method and from half its number's."""
    k = F.col("o_orderkey")
    users = F.array(k, F.floor(k / 2))
    return _orders(spark, sf_dir).select(k, F.explode(users).alias("user")).select(
        order_project(k).alias("project_id"), order_uri(k).alias("target_uri"),
        F.lit(3).alias("target_line"), F.lit(8).alias("target_char"),
        order_uri(F.col("user")).alias("ref_uri"), F.lit(8).alias("ref_line"), F.lit(11).alias("ref_char"))


# --- documents as source text --------------------------------------------------------
# fixed values: words of the prose that are read as code
CODE_WORDS = [
    (" the ", " return new Box "), (" and ", " if (x.isEmpty) "), (" la ", " await go.to() "),
    (" de ", " // note "), (" of ", " 'quo\"te' "), (" is ", " list.length > 3 "), (" in ", " switch (a) "),
    (" en ", " /* c */ "), (" der ", " throw FooException "), (" die ", " null check "),
    (" und ", " http.get( "), (" el ", " a ? b : c "), (" que ", " setState( "),
    (" les ", " Navigator.push( "), (" y ", " emit( "), (" los ", " return a.b "), (" an ", " \"open "),
    (" for ", " import 'package:for_kit/x.dart' "), (" that ", " import \"package:that_kit/y.dart\" "),
]


def code_text(c: Column) -> Column:
    return reduce(lambda s, pair: F.replace(s, F.lit(pair[0]), F.lit(pair[1])), CODE_WORDS, c)


def code_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text").select(
        "doc_id", "lang", F.col("source").alias("project_id"), text("doc:", F.col("doc_id")).alias("file_uri"),
        F.when(F.col("doc_id") % 2 == 0, "method").otherwise("function").alias("kind"),
        code_text(F.col("text")).alias("code"))


# --- pages as a project tree ---------------------------------------------------------
def page_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, file_uri, rel_path: twelve places a file can sit in."""
    i = F.col("page_id")
    lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1)
    places = [
        text("lib/", lang, "/", i, ".dart"), F.lit("pubspec.yaml"), text(lang, "/", i, ".dart"),
        text(lang, "/a/b/", i, ".dart"), text("deep", i, "/a/b/c/", i, ".dart"), text("_own/", i, ".dart"),
        text(".dart_tool/", i, ".dart"), text("packages/p", i, "/lib/src/", i, ".dart"),
        text("features/", lang, "/lib/", i, ".dart"), text("test/", i, ".dart"), text("web/", i, ".dart"),
        text(lang, "_x/.hid/", i, ".dart"),
    ]
    rel = F.element_at(F.array(*places), (i % 12 + 1).cast("int"))
    project = text("site", F.floor(i / 5) % 23)
    return table(spark, sf_dir, "pages").select(
        project.alias("project_id"), F.concat(F.lit("file:///"), project, F.lit("/"), rel).alias("file_uri"),
        rel.alias("rel_path"))


# --- supplier package manifests ------------------------------------------------------
def supplier_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One package manifest per supplier project."""
    k = F.col("s_suppkey")
    entries = F.concat(
        text('{"name":"http_', k, '","rootUri":"file:///pub/http_', k, '","version":"1.', k % 9, '"},'),
        text('{"name":"own_', k, '","rootUri":"../modules/./own_', k, '/"},'),
        F.lit('{"name":"flutter","rootUri":"file:///sdk/flutter","version":"3"},{"name":"","rootUri":"x"},'),
        text('{"name":"dev_', k, '","rootUri":"file:///pub/dev%20', k, '"},{"name":"norooturi"},'),
        text('{"name":"core_', k, '","rootUri":"file:///opt/dart-sdk/pkg/', k, '"},'),
        text('{"name":"path_', k, '","rootUri":"file:///other/path_', k, '","version":""},'),
        text('{"name":"c++(', k, '","rootUri":"file:///odd/cpp"},{"name":"a.b+', k, '","rootUri":"file:///odd/dots"},'),
        text('{"name":"flutter_', F.col("s_nationkey"), '","rootUri":"file:///pub/fl"}'))
    return table(spark, sf_dir, "supplier").select(
        text("s", k).alias("project_id"), text("/work/s", k, "/.dart_tool").alias("config_dir"),
        F.concat(F.lit('{"configVersion":2,"packages":['), entries, F.lit("]}")).alias("text"))


def supplier_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    spec = F.concat(
        F.lit("name: shop\ndependencies:\n  "), text("path_", k), F.lit(":\n    path: ../path\n"),
        F.when(k % 2 == 0, text("dev_dependencies:\n  lints: 1\n  dev_", k, ": ^1.0\n  c++(", k, ": 1\n  aXb+", k, ": 1\n")).otherwise(""))
    return table(spark, sf_dir, "supplier").select(
        text("s", k).alias("project_id"), text("/work/s", k).alias("root"), spec.alias("root_spec"))


def supplier_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of the http packages."""
    k = F.col("s_suppkey")
    body = F.concat(
        text("name: http_", k, "\ndescription:  'Talks to \""), F.col("s_name"), F.lit("\"' \n"),
        F.when(k % 3 == 0, "dependencies:\n  flutter:\n    sdk: flutter\n").otherwise(""))
    return table(spark, sf_dir, "supplier").select(
        text("s", k).alias("project_id"), text("/pub/http_", k).alias("dir"), body.alias("content"))


# --- nation message catalogue --------------------------------------------------------
def nation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, key, template): English for all nations, Spanish left open for some."""
    n = table(spark, sf_dir, "nation")
    en = n.select(F.lit("en").alias("lang"), F.col("n_name").alias("key"),
                  F.concat(F.lit("{0} trades with "), F.col("n_name"), F.lit(" for {1} ({0})")).alias("template"))
    es = n.select(
        F.lit("es").alias("lang"), F.col("n_name").alias("key"),
        F.when(F.col("n_regionkey") < 3, F.concat(F.lit("{1}: {0} comercia con "), F.col("n_name"))).alias("template"))
    return en.unionByName(es)


def order_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package per folder of each order project but the last folder; even ones are the project's own."""
    k = F.col("o_orderkey")
    j = F.col("folder")
    # the last folder has no package of its own
    folders = table(spark, sf_dir, "orders").select(
        order_project(k).alias("project_id"), F.when(k % 10 < 9, k % 10).alias("folder")).dropna().distinct()
    return folders.select(
        "project_id", j.cast("int").alias("pkg_ord"), text("pkg_f", j).alias("name"),
        text("/lake/", F.col("project_id"), "/lib/f", j).alias("path"), F.lit("1.0").alias("version"),
        F.when(j % 2 == 0, "custom").otherwise("third_party").alias("type"))


# --- conversations as containers -----------------------------------------------------
def conversation_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation > turn > text symbols with explicit paths, each row giving its own three levels.

    The conversation row comes from every first turn; turns of system role carry no selection range.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    kind = F.when(F.col("role") == "assistant", 6).when(F.col("role") == "user", 9).otherwise(8)
    path = F.array(conv.cast("int"), turn.cast("int"))
    rng = F.struct(*[(turn * 10 + i).cast("int").alias(n) for i, n in enumerate(("sl", "sc", "el", "ec"))])
    level = F.explode(F.array(
        F.struct(F.slice(path, 1, 1).alias("sym_path"), text("Conv", conv).alias("name"),
                 F.when(conv % 3 == 0, 10).otherwise(5).alias("kind"), (turn == 0).alias("keep")),
        F.struct(path.alias("sym_path"), text(F.col("role"), "_", turn % 3).alias("name"), kind.alias("kind"), F.lit(True).alias("keep")),
        F.struct(F.concat(path, F.array(F.lit(0))).alias("sym_path"), text("t", F.length("text") % 7).alias("name"),
                 F.lit(12).alias("kind"), F.lit(True).alias("keep")),
    )).alias("s")
    rows = table(spark, sf_dir, "conversations").select(
        text("room", conv % 10).alias("project_id"), text("chat:", conv).alias("file_uri"), F.col("role"),
        F.when(F.col("role") != "system", rng).alias("sel_rng"), level)
    return rows.filter("s.keep").select("project_id", "file_uri", "role", "sel_rng", "s.sym_path", "s.name", "s.kind")
