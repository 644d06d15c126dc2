"""Operators on small graphs and against brute force."""

import json
import os
import random
import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from codeloom.operators import calls as C, edges as E, enrich as R, graph as G, nodes as N, packages as P, relations as L, views as V
from codeloom.plans import bindings
from codeloom.plans.code_graph import build_graph
from codeloom.functions.symbols import id_tail, id_whole
from codeloom.queries import code
from codeloom.queries.code import type_evidence
from codeloom.schemas import FILES, HOVERS, REFS, SYMBOL_TREES
from codeloom.session import written
from codeloom.sources import files as S, messages as M
from codeloom.sources.sinks import published, read_graph, with_ordinals, write_graph
from codeloom.sources.symbols import flatten_trees
from tests.conftest import SF_DIR

EDGE = "project_id string, edge_ord bigint, source string, target string, label string"
EDGE_COLS = ["project_id", "edge_ord", "source", "target", "label"]
PKG = "project_id string, pkg_ord int, name string, path string, version string, type string"


def test_degrees(spark):
    nodes = spark.createDataFrame([("p", n) for n in "ABCD"], "project_id string, node_id string")
    edges = spark.createDataFrame([
        ("p", 1, "A", "B", "CALLS"), ("p", 2, "B", "C", "CALLS"), ("p", 3, "A", "C", "READS_FROM"), ("p", 4, "A", "ghost", "CALLS")], EDGE)
    got = {r.node_id: (r.in_degree, r.out_degree) for r in G.with_degrees(nodes, edges).collect()}
    assert got == {"A": (0, 3), "B": (1, 1), "C": (2, 0), "D": (0, 0)}
    assert G.with_degrees(nodes.limit(0), edges.limit(0)).count() == 0


def brute_flow(edges, start, hops=10):
    path, seen, at = [start], {start}, start
    for _ in range(hops):
        nxt = next((s for _, s, t, l in edges if t == at and l == "WRITES_TO" and s not in seen), None)
        if nxt is None:
            break
        path.insert(0, nxt), seen.add(nxt)
        at = nxt
    at = start
    for _ in range(hops):
        nxt = next((t for _, s, t, l in edges if s == at and l == "READS_FROM" and t not in seen), None)
        if nxt is None:
            break
        path.append(nxt), seen.add(nxt)
        at = nxt
    return path


def _ended(edges, start, hops):
    path = brute_flow(edges, start, hops)
    back = path.index(start)
    more_back = back == hops and any(t == path[0] and l == "WRITES_TO" and s not in path[:back + 1] for _, s, t, l in edges)
    more_on = len(path) - 1 - back == hops and any(s == path[-1] and l == "READS_FROM" and t not in path for _, s, t, l in edges)
    return not more_back and not more_on


def test_flow_equals_brute_force(spark):
    rnd = random.Random(5)
    edges = [(i, f"n{rnd.randrange(30)}", f"n{rnd.randrange(30) if rnd.random() < .7 else 0}", rnd.choice(["READS_FROM", "WRITES_TO", "CALLS"]))
             for i in range(600)]
    starts = [f"n{i}" for i in range(30)] + ["unknown"]
    df = spark.createDataFrame([("p", *e) for e in edges], EDGE)
    asked = spark.createDataFrame([("p", s) for s in starts], "project_id string, start string")
    got = {r.start: r.path for r in G.trace_flow(df, asked).collect()}
    assert got == {s: brute_flow(edges, s) for s in starts}
    for hops in (2, 10):
        short = {r.start: (r.path, r.complete) for r in G.trace_flow(df, asked, hops=hops).collect()}
        # a walk is complete when more hops lead to the same path
        assert short == {s: (brute_flow(edges, s, hops), _ended(edges, s, hops)) for s in starts}
    assert max(len(p) for p in got.values()) <= 21 and all(len(set(p)) == len(p) for p in got.values())


def test_line_owners_equal_brute_force(spark):
    rnd = random.Random(9)
    spans = [("p", f"f{rnd.randrange(3)}", f"n{i}", i, lo, lo + rnd.choice([0, 3, 70, 900])) for i in range(200) for lo in [rnd.randrange(400)]]
    spans += [("p", "f9", "endless", 900, 3, 2**31 - 1), ("p", "f9", "one", 901, 2**31 - 1, 2**31 - 1)]
    points = [("p", f"f{rnd.randrange(4)}", rnd.randrange(1400)) for _ in range(500)]
    points += [("p", "f9", line) for line in (0, 2, 3, 4, 10**9, 2**31 - 1)]
    got = E.line_owners(
        spark.createDataFrame(spans, "project_id string, file_uri string, node_id string, ord int, sl int, el int"),
        spark.createDataFrame(points, "project_id string, file_uri string, line int")).collect()
    want = {}
    for _, f, line in points:
        hit = next((n for _, g, n, _, lo, hi in spans if g == f and lo <= line <= hi), None)
        if hit:
            want[(f, line)] = hit
    assert {(r.file_uri, r.line): r.node_id for r in got} == want


def test_ordinals_are_dense_per_group(spark):
    rows = [("big", i * 7 % 5003) for i in range(5000)] + [("small", i) for i in range(3)]
    got = with_ordinals(spark.createDataFrame(rows, "g string, k int").repartition(7), "g", ["k"], "n").collect()
    for g in ("big", "small"):
        mine = sorted((r.k, r.n) for r in got if r.g == g)
        assert [n for _, n in mine] == list(range(len(mine)))


def test_text_reaches_every_row_of_a_crowded_file(spark):
    files = spark.createDataFrame([("p", "f", None, "a\nb\nc"), ("p", "g", None, "x")], FILES)
    rows = spark.range(100).select(F.lit("p").alias("project_id"), F.when(F.col("id") < 95, "f").when(F.col("id") < 99, "g").otherwise("none").alias("file_uri"), "id")
    found = R.with_file_text(rows, files, lambda lines: F.concat_ws("|", F.get(lines, (F.col("id") % 3).cast("int")), F.col("id").cast("string")), "t")
    got = found.collect()
    assert len(got) == 100 and found.columns == ["project_id", "file_uri", "id", "t"]
    for r in got:
        line = {"f": "abc"[r.id % 3], "g": "x" if r.id % 3 == 0 else None, "none": None}[r.file_uri]
        assert r.t == "|".join(x for x in (line, str(r.id)) if x is not None)


@contextmanager
def settings(spark, **values):
    """Settings for one test; names with __ for dots."""
    old = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in values}
    for k, v in values.items():
        spark.conf.set(k.replace("__", "."), v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def executed_plan(df):
    """The final plan of a run, and the rows."""
    rows = df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0], rows


def test_a_large_file_with_many_symbols_travels_once(spark):
    """200 KB and 20,000 symbols: the file is shuffled once, the slices are read in the stage of the join."""
    content = "\n".join(f"line {i} " + "x" * 90 for i in range(2000))
    files = spark.createDataFrame([("p", "f", None, content)], FILES).repartition(2)
    rng = F.struct((F.col("id") % 2000).cast("int").alias("sl"), F.lit(5).alias("sc"), (F.col("id") % 2000 + F.col("id") % 2).cast("int").alias("el"), F.lit(9).alias("ec"))
    rows = spark.range(20_010).select(F.lit("p").alias("project_id"), F.when(F.col("id") < 20_000, "f").otherwise("g").alias("file_uri"),
                                      "id", rng.alias("rng"), rng.alias("sel_rng"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        found = R.slice_bodies(rows, files)
        plan, got = executed_plan(found)
    text = content.split("\n")
    for r in got:
        a, b = r.id % 2000, r.id % 2000 + r.id % 2
        assert r.file_uri == "f" or r.body == ""
        assert r.file_uri == "g" or r.body == (text[a][5:9] if a == b else "" if b == 2000 else text[a][5:] + "\n" + text[b][:9])
    joins = [line for line in plan.split("\n") if "SortMergeJoin" in line]
    reads = [line for line in plan.split("\n") if "Project" in line and "coalesce(CASE WHEN" in line]
    assert len(joins) == 1 and len(reads) == 1
    # a star and the same stage number: the slices are read where the join runs
    stage = re.compile(r"\*\((\d+)\)")
    assert stage.search(joins[0])[1] == stage.search(reads[0])[1]
    assert plan.count("Exchange hashpartitioning(") == 2


def test_first_and_last_win(spark):
    rows = spark.createDataFrame([("p", "a", 2, "x"), ("p", "a", 1, "y"), ("p", "a", 3, "z")], "project_id string, node_id string, ord int, v string")
    assert N.first_wins(rows, ["project_id", "node_id"], "ord").first().v == "y"
    assert N.last_wins(rows, ["project_id", "node_id"], "ord").first().v == "z"


def test_file_sources(spark):
    files = [("p", u, u) for u in ("/proj/lib/a.dart", "/dart-sdk/lib/core.dart", "/packages/http/lib/h.dart", "/packages/http_parser/x.dart", "/mine/lib/m.dart", "")]
    packages = [("p", 0, "http", "/packages/http", "1.0.0", "third_party"), ("p", 1, "mine", "/mine/", "1", "custom")]
    got = {r.file_uri: r.source for r in P.file_sources(
        spark.createDataFrame(files, "project_id string, file_uri string, path string"), spark.createDataFrame(packages, PKG)).collect()}
    assert got["/proj/lib/a.dart"].type == "project" and got[""].type == "project"
    assert got["/dart-sdk/lib/core.dart"].type == "sdk"
    http = got["/packages/http/lib/h.dart"]
    assert (http.type, http.package_name, http.package_version, http.relative_path) == ("external_package", "http", "1.0.0", "lib/h.dart")
    assert got["/packages/http_parser/x.dart"].package_name is None
    assert (got["/mine/lib/m.dart"].type, got["/mine/lib/m.dart"].package_name) == ("project", "mine")


def test_nearest_root_at_any_depth(spark):
    deep = "/r/" + "/".join("abcdefghij")
    paths = spark.createDataFrame([("p", "/r/a/b"), ("p", deep), ("p", "/other")], "project_id string, path string")
    marks = spark.createDataFrame([("p", "/r"), ("p", "/r/a")], "project_id string, dir string")
    got = {r.path: r.root for r in S.nearest_roots(paths, marks).collect()}
    assert got == {"/r/a/b": "/r/a", deep: "/r/a", "/other": None}
    far = deep + "/k/l"
    assert S.nearest_roots(spark.createDataFrame([("p", far)], paths.schema), marks).first().root == "/r/a"


def test_scan_and_choose_sources(spark, tmp_path):
    for rel in ("a/lib/x.dart", "a/lib/sub/y.dart", "a/pubspec.yaml", "a/custom/z.dart", "a/test/t.dart", "a/.dart_tool/g.dart", "b/any/w.dart"):
        f = tmp_path / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"// {rel}\nclass X {{}}\n")
    found = S.scan_sources(spark, str(tmp_path))
    listing = found.select("project_id", "file_uri", "rel_path").unionByName(
        spark.createDataFrame([("a", "spec", "pubspec.yaml")], "project_id string, file_uri string, rel_path string"))
    chosen = S.distinct_files(S.matched_files(listing)).collect()
    assert {(r.project_id, r.rel_path) for r in chosen} == {("a", "lib/x.dart"), ("a", "lib/sub/y.dart"), ("a", "custom/z.dart"), ("b", "any/w.dart")}
    assert found.filter("rel_path = 'lib/x.dart'").first().content == "// a/lib/x.dart\nclass X {}\n"


def test_second_scan_reads_changed_files_only(spark, tmp_path):
    """Ten files; then one changes, one comes, one goes: the second scan opens two."""
    lake = tmp_path / "lake"
    for i in range(10):
        path = lake / f"p{i % 2}" / "lib" / f"f{i}.dart"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"class A{i} {{}}")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    (lake / "p0" / "notes.txt").write_text("no source")
    first = written(S.list_sources(spark, str(lake)))
    assert first.count() == 10 and {r.rel_path for r in first.collect()} == {f"lib/f{i}.dart" for i in range(10)}
    everything = S.scan_changed(spark, str(lake), first, first.limit(0))
    assert sorted(map(str, everything.collect())) == sorted(map(str, S.scan_sources(spark, str(lake)).collect()))

    (lake / "p1" / "lib" / "f3.dart").write_text("class B {}")
    (lake / "p0" / "lib" / "new.dart").write_text("class N {}")
    (lake / "p0" / "lib" / "f4.dart").unlink()
    second = written(S.list_sources(spark, str(lake)))
    changes = {(r.file_uri.rsplit("/", 1)[1], r.change) for r in S.compare_manifests(second, first).collect()}
    assert changes == {("f3.dart", "changed"), ("new.dart", "added"), ("f4.dart", "removed")}
    with settings(spark, spark__sql__adaptive__enabled="false"):
        found = S.scan_changed(spark, str(lake), second, first)
        assert sorted(r.content for r in found.collect()) == ["class B {}", "class N {}"]
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        texts = [s for s in scans if "text" in s.nodeName().lower()]
        assert [s.metrics().get("numFiles").get().value() for s in texts] == [2]
    assert S.scan_changed(spark, str(lake), second, second).collect() == []
    # a file that comes with an old date is found too
    old = lake / "p0" / "lib" / "old.dart"
    old.write_text("class O {}")
    os.utime(old, (1_600_000_000, 1_600_000_000))
    third = S.list_sources(spark, str(lake))
    assert [r.content for r in S.scan_changed(spark, str(lake), third, second).collect()] == ["class O {}"]


@pytest.mark.parametrize("rule, column", [("hover_field_type", "resolved_type"), ("own_field_params", "param_names"), ("hover_return_type", "return_type")])
def test_each_hover_rule_counts(spark, monkeypatch, rule, column):
    """Without a rule, what it alone tells is missing from `type_evidence`."""
    whole = type_evidence(spark, "/root/testdata/sf0.001")
    values = whole.select(column).filter(F.col(column).isNotNull()).distinct().count()
    kind = "array<struct<pos:int,name:string,type:string,is_named:boolean,is_required:boolean,is_optional_positional:boolean>>" \
        if rule == "own_field_params" else "string"
    monkeypatch.setattr(R.sig, rule, lambda *_, **__: F.lit(None).cast(kind))
    without = type_evidence(spark, "/root/testdata/sf0.001")
    assert without.select(column).filter(F.col(column).isNotNull()).distinct().count() < values


def test_messages_from_files(spark, tmp_path):
    (tmp_path / "en.json").write_text(json.dumps({"a": "A {0}", "b": "B"}))
    (tmp_path / "es.json").write_text(json.dumps({"a": "Á {0}"}))
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    got = M.with_template(rows, M.read_messages(spark, str(tmp_path)), "es", "key", "t").collect()
    assert {r.key: r.t for r in got} == {"a": "Á {0}", "b": "B", "c": "c"}
    shipped = M.builtin_messages()
    assert shipped["es"].keys() == shipped["en"].keys()
    got = M.with_template(rows.limit(1).withColumn("key", F.lit("verb.calls")), shipped, "es", "key", "t").first()
    assert got.t == shipped["es"]["verb.calls"]


def _sym(name, kind, sl, el, children=(), detail=""):
    rng = {"start": {"line": sl, "character": 0}, "end": {"line": el, "character": 99}}
    sel = {"start": {"line": sl, "character": 2}, "end": {"line": sl, "character": 9}}
    return {"name": name, "detail": detail, "kind": kind, "range": rng, "selectionRange": sel, "children": list(children)}


def test_flatten_any_depth(spark):
    tree = _sym("leaf", 12, 1, 1)
    for i in range(20):
        tree = _sym(f"n{i}", 5, 0, 9, [tree])
    rows = spark.createDataFrame([("p", "f", "ok", json.dumps([tree])), ("p", "g", "error", "oops"), ("p", "h", "empty", "[]")], SYMBOL_TREES)
    got = flatten_trees(rows).orderBy("depth").collect()
    assert len(got) == 21 and got[0].parent_uid is None
    assert got[-1].name == "leaf" and got[-1].parent_uid == "f#n0#5" and got[-1].parent_node_id == got[-2].node_id


SHOP = """import 'package:http/http.dart';
class Shop extends Store implements Port {
  final List<Item> items;
  Shop({required this.items});
  Future<int> load() {
    items(1); // skip()
    return refresh();
  }
  void refresh() { print("load()"); }
}
"""


def test_whole_graph_of_two_files(spark, tmp_path):
    shop = _sym("Shop", 5, 1, 9, [
        _sym("items", 8, 2, 2), _sym("Shop", 9, 3, 3, detail="({required this.items})"),
        _sym("load", 6, 4, 7, detail="Future<int> load()"), _sym("refresh", 6, 8, 8)],
        detail="class Shop extends Store implements Port")
    base = [_sym("Store", 5, 0, 0), _sym("Port", 5, 1, 1), _sym("Item", 5, 2, 2)]
    uri, base_uri = "file:///w/app/lib/shop.dart", "file:///pub/base/lib/base.dart"
    files = spark.createDataFrame([("p", uri, "lib/shop.dart", SHOP), ("p", base_uri, "lib/base.dart", "class Store{}\nclass Port{}\nclass Item{}\n")], FILES)
    trees = spark.createDataFrame([("p", uri, "ok", json.dumps([shop])), ("p", base_uri, "ok", json.dumps(base))], SYMBOL_TREES)
    refs = spark.createDataFrame([("p", uri, 2, 2, uri, 5, 4), ("p", uri, 2, 2, uri, 0, 0)], REFS)
    packages = spark.createDataFrame([("p", 0, "base", "/pub/base", "2.0", "third_party")], PKG)
    hovers = spark.createDataFrame([("p", uri, 8, 2, ["```dart\nvoid refresh()\n```"])], HOVERS)
    graph = build_graph(flatten_trees(trees), files, hovers, refs, packages)
    short = lambda i: i.rsplit("name:", 1)[-1]
    edges = {(short(r.source), short(r.target), r.label) for r in graph.edges.collect()}
    assert edges == {
        ("Shop", "Store", "EXTENDS"), ("Shop", "Port", "IMPLEMENTS"), ("load", "refresh", "CALLS"),
        ("load", "items", "READS_FROM"), ("project_root", "package_container:base", "USES_AS_TYPE")}
    symbols = {(r.name, r.kind): r for r in graph.symbols.collect()}
    assert symbols[("items", 8)].resolved_type == "final List<Item>"
    assert symbols[("load", 6)].return_type == "Future<int>"
    # its hover says void: settled, the source text isn't asked
    assert symbols[("refresh", 6)].return_type is None
    assert [p.type for p in symbols[("Shop", 9)].params] == ["self_field:items"]
    nodes = {short(r.node_id): r for r in graph.nodes.collect()}
    assert nodes["Store"].display_label == "\U0001F517 Store" and nodes["Store"].parent == "package_container:base"
    assert nodes["Shop"].layer == "service" and nodes["load"].layer == "member"
    own = R.resolve_own_fields(R.param_rows(graph.symbols), graph.symbols).first()
    assert own.type == "final List<Item>"
    write_graph(graph.nodes.drop("ord"), graph.edges, str(tmp_path / "out"))
    read = read_graph(spark, str(tmp_path / "out"))
    assert read[1].count() == len(edges) and read[0].count() == len(nodes)
    assert read[0].columns == graph.nodes.drop("ord").columns


def test_edges_are_unique_and_known(spark):
    nodes = spark.createDataFrame([("p", "a"), ("p", "b")], "project_id string, node_id string")
    raw = spark.createDataFrame([("p", 0, *e) for e in (("a", "b", "CALLS"), ("a", "b", "CALLS"), ("a", "a", "CALLS"), ("a", "x", "CALLS"), ("", "b", "CALLS"), ("b", "a", "CALLS"))], EDGE)
    got = {(r.source, r.target) for r in E.admit(raw, nodes).collect()}
    assert got == {("a", "b"), ("b", "a")}


def test_imports_split_by_package_type(spark):
    imports = spark.createDataFrame([("p", "n", x) for x in ("http", "mine", "unknown")], "project_id string, node_id string, package string")
    packages = spark.createDataFrame([("p", 0, "http", "/h", "1", "third_party"), ("p", 1, "mine", "/m", "1", "custom")], PKG)
    got = {r.package: r.role for r in G.package_uses(imports, packages).collect()}
    assert got == {"http": "external_import", "mine": "own_import", "unknown": "external_import"}
    assert {r.package_group: r.n_packages for r in V.package_overview(packages).collect()} == {"consumed": 1, "developed": 1}


def crowd(spark, n, name="build"):
    """n methods of one name, each calling it, and n more names that nobody has."""
    source = F.concat(F.lit("m"), F.col("id").cast("string"))
    callers = spark.range(n).select(F.lit("p").alias("project_id"), source.alias("source"), F.lit(name).alias("name"))
    named = spark.range(n).select(F.lit("p").alias("project_id"), source.alias("node_id"), F.lit(name).alias("name"), F.lit("method").alias("kind"))
    return C.halves(callers.unionByName(callers.withColumn("name", F.lit("if"))), named)


def test_views_of_calls_without_pairs(spark):
    """2,000 callers of one name with 2,000 targets: 3,998,000 calls, none of them built by any view."""
    n = 2000
    calls = crowd(spark, n)
    nodes = spark.range(n).select(
        F.lit("p").alias("project_id"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("node_id"),
        F.struct((F.col("id") % 2).cast("string").alias("feature"), (F.col("id") % 4).cast("string").alias("folder")).alias("at"))
    got = {r.node_id: (r.in_degree, r.out_degree) for r in C.degrees(calls).collect()}
    assert len(got) == n and set(got.values()) == {(n - 1, n - 1)}
    assert [tuple(r) for r in C.totals(calls).collect()] == [("p", n * (n - 1))]
    quarter, half = (n // 4) ** 2, (n // 2) ** 2
    lifted = {(r.level, r.source, r.target): r.n_edges for r in V.lifted(C.folder_pairs(calls, nodes)).collect()}
    assert lifted == {**{("folder", str(a), str(b)): quarter for a in range(4) for b in range(4) if a != b},
                      ("feature", "0", "1"): half, ("feature", "1", "0"): half}
    focus = spark.createDataFrame([("p", "m7")], "project_id string, focus string")
    near = C.around(calls, focus)
    assert near.count() == 2 * (n - 1)
    # no operator of these plans puts out more than a few rows per symbol
    for df in (C.degrees(calls), C.totals(calls), C.folder_pairs(calls, nodes), near):
        assert most_rows(df) <= 4 * n


def most_rows(df):
    """The most rows that any operator of a run has put out."""
    with settings(df.sparkSession, spark__sql__adaptive__enabled="false"):
        df = df.select("*")
        df.collect()
        found, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            plan = todo.pop()
            metric = plan.metrics().get("numOutputRows")
            found = max(found, metric.get().value()) if metric.isDefined() else found
            todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def random_calls(seed):
    rnd = random.Random(seed)
    names = ["a", "b", "analytics", "openDialog", "if"]
    mentioned = {(rnd.choice("pq"), f"m{rnd.randrange(40)}", rnd.choice(names)) for _ in range(200)}
    symbols = [(p, f"m{i}", rnd.choice(names[:4]), rnd.choice(["method", "method", "function", "field", "class"])) for p in "pq" for i in range(40)]
    return sorted(mentioned), symbols


def test_views_of_calls_equal_those_of_the_edges(spark):
    mentioned, symbols = random_calls(4)
    rnd = random.Random(6)
    m = spark.createDataFrame(mentioned, "project_id string, source string, name string")
    s = spark.createDataFrame(symbols, "project_id string, node_id string, name string, kind string")
    nodes = spark.createDataFrame(
        [(p, i, n, k, rnd.choice(["view", "state", "service", "model", "member"]), f"m{rnd.randrange(40)}", rnd.choice("xy"), rnd.choice("uvw"))
         for p, i, n, k in symbols],
        "project_id string, node_id string, label string, kind string, layer string, parent string, feature string, folder string")
    few = spark.createDataFrame([("p", "m1", "m2", "EXTENDS"), ("p", "m3", "m1", "READS_FROM"), ("q", "m5", "m9", "READS_FROM"), ("r", "m1", "m2", "EXTENDS")],
                                "project_id string, source string, target string, label string")
    calls = C.halves(m, s)
    edges = few.unionByName(C.pairs(calls))
    brute = {(p, a, i) for p, a, n in mentioned for q, i, n2, k in symbols if p == q and n == n2 and k in ("method", "function") and a != i}
    assert sorted((r.project_id, r.source, r.target) for r in C.pairs(calls).collect()) == sorted(brute)

    def same(a, b):
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect())) != []
    pairs_only = C.pairs(calls)
    same(C.degrees(calls), G.degree_counts(pairs_only))
    same(C.totals(calls), G.edge_counts(pairs_only))
    at = V.places(nodes)
    same(V.lifted(V.folder_pairs(few, at).unionByName(C.folder_pairs(calls, at))), V.lifted_edges(edges, nodes))
    focus = nodes.filter("node_id < 'm25'").select("project_id", "node_id")
    same(G.neighbourhood(nodes, few, focus, calls), G.neighbourhood(nodes, edges, focus))
    by_pairs = L.verb_groups(L.focus_relations(L.verbed_edges(edges.withColumn("edge_ord", F.col("label")), nodes)))
    same(L.graph_verb_groups(few, calls, nodes), by_pairs)


def test_projects_are_published_one_by_one(spark, tmp_path):
    folder = str(tmp_path / "graphs")
    N2, E2 = "project_id string, node_id string, n int", "project_id string, source string, target string"

    def write(nodes, edges):
        write_graph(spark.createDataFrame(nodes, N2), spark.createDataFrame(edges, E2), folder)

    def read():
        nodes, edges = read_graph(spark, folder)
        assert nodes.columns == ["project_id", "node_id", "n"] and edges.columns == ["project_id", "source", "target"]
        return sorted(map(tuple, nodes.collect())), sorted(map(tuple, edges.collect()))
    write([("p1", "a", 1), ("p1", "b", 1)], [("p1", "a", "b")])
    write([("p2", "x", 1), ("007", "k", 1)], [("p2", "x", "x")])
    assert read() == ([("007", "k", 1), ("p1", "a", 1), ("p1", "b", 1), ("p2", "x", 1)], [("p1", "a", "b"), ("p2", "x", "x")])
    write([("p1", "a", 2)], [])  # the new analysis has one node and no edge
    assert read() == ([("007", "k", 1), ("p1", "a", 2), ("p2", "x", 1)], [("p2", "x", "x")])
    # a job that dies before it publishes changes nothing
    spark.createDataFrame([("p2", "lost", 9)], N2).write.partitionBy("project_id").parquet(f"{folder}/nodes/version=9-dead")
    assert read() == ([("007", "k", 1), ("p1", "a", 2), ("p2", "x", 1)], [("p2", "x", "x")])
    assert published(spark, folder).count() == 3


def test_links_are_exchanged_once_per_direction(spark):
    """Too large to broadcast, the link table is dealt out once for all hops of a direction."""
    rnd = random.Random(2)
    edges = spark.createDataFrame([("p" if i % 2 else "q", i, f"n{rnd.randrange(200)}", f"n{rnd.randrange(200)}", rnd.choice(["READS_FROM", "WRITES_TO"]))
                                   for i in range(3000)], EDGE)
    starts = spark.createDataFrame([("p" if i % 2 else "q", f"n{i}") for i in range(300)], "project_id string, start string")
    plain = sorted(map(str, G.trace_flow(edges, starts).collect()))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        plan, rows = executed_plan(G.trace_flow(edges, starts))
    assert sorted(map(str, rows)) == plain
    scans = [line for line in plan.split("\n") if "Scan parquet" in line and "links#" in line]
    assert plan.count("ReusedExchange") >= 9 and len(scans) == 1


def test_trees_of_any_depth_are_written_once_per_pass_without_their_ids(spark, monkeypatch):
    """Nine levels make three tables of a few columns, not nine checkpoints of whole rows."""
    from codeloom.sources import symbols

    def tree(depth: int) -> dict:
        below = [tree(depth + 1), {"name": "leaf", "kind": 8}] if depth < 9 else []
        return {"name": f"s{depth}", "kind": 5 if depth == 1 else 12, "detail": "d", "children": below}
    tables = []
    monkeypatch.setattr(symbols, "written", lambda df: tables.append(df.columns) or written(df))
    rows = spark.createDataFrame([("p", "u", json.dumps([tree(1)])), ("p", "v", "[]"), ("p", "w", None)], "project_id string, file_uri string, tree string")
    got = {tuple(r.sym_path): r for r in symbols.flatten_trees(rows).collect()}
    assert len(got) == 17 and {len(p) for p in got} == set(range(1, 10))
    for depth in range(1, 10):
        r = got[(0,) * depth]
        up = None if depth == 1 else f"s{depth - 1}"
        assert (r.name, r.depth, r.parent_name, r.n_children) == (f"s{depth}", depth, up, 2 if depth < 9 else 0)
        over = None if depth == 1 else got[(0,) * (depth - 1)]
        assert (r.parent_uid, r.parent_node_id) == (over and over.symbol_uid, over and over.node_id)
    assert [got[(0,) * d + (1,)].parent_node_id for d in range(1, 9)] == [got[(0,) * d].node_id for d in range(1, 9)]
    assert len(tables) == 3 and not {"node_id", "symbol_uid", "parent_node_id"} & set(tables[0])


def test_admission_has_no_exchange_of_its_own(spark):
    """Both joins exchange the edges; folding the repeats doesn't do it again."""
    edges = spark.createDataFrame([("p", s, t, "L") for s, t in [("a", "b"), ("a", "b"), ("a", "a"), ("a", "x"), ("", "b"), ("x", "b"), ("b", "a"), (None, "b")]],
                                  "project_id string, source string, target string, label string")
    nodes = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "b")], "project_id string, node_id string")
    got = E.admit(edges, nodes.hint("merge"))
    assert sorted(tuple(r) for r in got.collect()) == [("p", "a", "b", "L"), ("p", "b", "a", "L")]
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 4


def test_trade_edges_are_folded_by_numbers(spark, tmp_path):
    """Repeats fold before names are made; a null key gives an end without a name, as one edge."""
    from codeloom.plans import bindings as B
    spark.createDataFrame(
        [(1, 1, 7, 5, "A"), (1, 2, 7, 5, "A"), (1, 3, 7, 5, "N"), (2, 1, 8, 5, None), (2, 2, None, 5, "R"), (3, 1, 7, 5, "A")],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 4), (2, 4)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    edges = B.trade_edges(spark, str(tmp_path))
    assert {(r.source, r.target, r.label): r.edge_ord for r in edges.collect()} == {
        ("customer:4", "part:7", "CALLS"): 9, ("customer:4", "part:7", "INSTANCE_OF"): 11, ("customer:4", "part:8", "USES_AS_TYPE"): 17,
        ("customer:4", None, "USES_AS_TYPE"): 18, ("part:7", "supplier:5", "READS_FROM"): 9, ("part:8", "supplier:5", "READS_FROM"): 17,
        (None, "supplier:5", "READS_FROM"): 18, ("supplier:5", "customer:4", "WRITES_TO"): 9}
    assert "hashpartitioning(kind" in edges._jdf.queryExecution().executedPlan().toString()


def test_exchange_files_go_with_their_query(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = []
        while found.hasNext():
            names.append(found.next().getName())
        return {n for n in names if n.startswith("shuffle_")}
    before = files()
    rows = written(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    assert files() <= before
    assert rows.agg(F.sum("n")).first()[0] == 1000


def test_trade_edges_by_source_need_no_exchange_for_it(spark):
    plain, dealt = (bindings.trade_edges(spark, SF_DIR, by_source=b).select(*EDGE_COLS) for b in (False, True))
    assert plain.exceptAll(dealt).isEmpty() and dealt.exceptAll(plain).isEmpty()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        told = L.verbed_edges(bindings.trade_edges(spark, SF_DIR, by_source=True), bindings.trade_nodes(spark, SF_DIR))
        plan = told._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # the one exchange by a column of this name is that of the nodes
    assert len(re.findall(r"Exchange hashpartitioning\(source#", plan)) == 1


def test_the_graph_keeps_one_table_of_symbols_without_their_ids(spark, monkeypatch):
    tables = []

    def kept(df):
        tables.append(written(df))
        return tables[-1]
    monkeypatch.setattr("codeloom.plans.code_graph.written", kept)
    flat = code._flat(spark, SF_DIR)
    graph = build_graph(flat, bindings.order_files(spark, SF_DIR), bindings.order_hovers(spark, SF_DIR),
                        bindings.order_refs(spark, SF_DIR), bindings.order_packages(spark, SF_DIR), keep_symbols=False)
    wide = [t for t in tables if {"sym_path", "rng"} & set(t.columns)]
    assert not any({"node_id", "parent_node_id", "symbol_uid", "parent_uid", "ord"} & set(t.columns) for t in wide)

    def files(df):
        return [f for f in df.inputFiles() if os.path.exists(f.removeprefix("file://"))]
    assert not files(flat) and sum(bool(files(t)) for t in wide) == 1
    assert graph.nodes.count() and graph.symbols.count() and graph.edges.count()


def test_marked_symbols_are_the_winners(spark):
    cols = "project_id string, node_id string, ord int, kind int, name string"
    rows = spark.createDataFrame([
        ("p", "a", 1, 5, "a1"), ("p", "a", 3, 6, "a3"), ("p", "a", 2, 5, "a2"), ("p", "b", 1, 5, "b"), ("q", "a", 9, 5, "q"),
        ("p", "c", 4, 5, "c"), ("p", "c", 4, 5, "c"), ("p", None, 1, None, "n1"), ("p", None, 2, 5, "n2"), ("p", None, 3, None, "n3"),
        ("q", None, 1, None, "alone")], cols)
    got = N.marked(rows)
    keys = ["project_id", "node_id"]

    def same(flag, expected):
        mine = got.filter(flag).select(*rows.columns)
        assert sorted(map(str, mine.collect())) == sorted(map(str, expected.select(*rows.columns).collect()))
    same("own", rows)
    same("first", N.first_wins(rows.filter("kind IS NOT NULL"), keys, "ord"))
    same("last", N.last_wins(rows, keys, "ord"))


@pytest.mark.parametrize("uri, whole", [("f", "f#x"), ("", "unknown_uri#x"), ("f", "g#x"), ("f", "f"), ("f", "=f"), ("f", "+")])
def test_an_id_moves_without_its_uri(spark, uri, whole):
    row = spark.createDataFrame([(uri, whole)], "uri string, id string").withColumn("tail", id_tail(F.col("id"), F.col("uri")))
    row = row.select("tail", id_whole(F.col("tail"), F.col("uri")).alias("back")).first()
    assert row.back == whole and (uri == "" or not row.tail.startswith("+" + uri))


def test_reads_of_bodies_equal_those_of_their_mentions(spark):
    refs = spark.createDataFrame([("p", "t", 3, 8, "r", 1, 0), ("p", "t", 3, 8, "r", 2, 0), ("p", "t", 4, 8, "r", 2, 0)], REFS)
    owners = spark.createDataFrame([("p", "r", 1, "r#f"), ("p", "r", 2, "r#g")], "project_id string, file_uri string, line int, node_id string")
    targets = spark.createDataFrame([("p", "t", 3, 8, "t#x", "x"), ("p", "t", 4, 8, "odd", "y")],
                                    "project_id string, target_uri string, target_line int, target_char int, target string, name string")
    spoken = spark.createDataFrame([("p", "r#f", ["x", "z"]), ("p", "r#g", ["y", "x"]), ("p", "s", ["x"])], "project_id string, source string, names array<string>")
    told = spoken.select("project_id", "source", F.explode("names").alias("name"))
    read = [{(r.source, r.target) for r in E.read_edges(refs, owners, targets, m).collect()} for m in (spoken, told)]
    assert read[0] == read[1] == {("r#f", "t#x"), ("r#g", "t#x"), ("r#g", "odd")}


def test_verb_groups_leave_only_their_rows(spark, monkeypatch):
    tables = []

    def kept(df):
        tables.append(written(df))
        return tables[-1]
    monkeypatch.setattr("codeloom.operators.relations.written", kept)
    ids = [f"n{i}" for i in range(4)]
    nodes = spark.createDataFrame([("p", i, i, "view") for i in ids], "project_id string, node_id string, label string, layer string")
    few = spark.createDataFrame([("p", "n0", "n1", "READS_FROM")], "project_id string, source string, target string, label string")
    calls = C.Calls(spark.createDataFrame([("p", "n3", "n2")], "project_id string, name string, source string"),
                    spark.createDataFrame([("p", "n3", "n3")], "project_id string, name string, target string"))
    got = {(r.focus, r.first_partner, r.n_partners) for r in L.graph_verb_groups(few, calls, nodes).collect()}
    assert got == {("n0", "n1", 1), ("n1", "n0", 1), ("n2", "n3", 1), ("n3", "n2", 1)}
    left = [t for t in tables if any(os.path.exists(f.removeprefix("file://")) for f in t.inputFiles())]
    assert len(tables) == 3 and [t.columns for t in left] == [t.columns for t in tables[1:]]


def test_settled_symbols_meet_neither_hovers_nor_texts(spark):
    # the detail tells all of a class and of a typed method: no exchange holds their rows
    cols = "project_id string, file_uri string, sym_path array<int>, name string, kind int, detail string, sel_rng struct<sl:int,sc:int,el:int,ec:int>, ord int"
    at = (0, 0, 0, 1)
    rows = written(spark.createDataFrame([("p", "f", [i], f"load{i}", 6, f"Future<int> load{i}()", at, i) for i in range(40)], cols))
    files = written(spark.createDataFrame([("p", "f", "f", "int x;")], FILES))
    hovers = written(spark.createDataFrame([("p", "f", 0, 0, ["int x"])], HOVERS))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false", spark__sql__maxPlanStringLength="100000000"):
        got = R.enrich(rows, files, hovers)
        plan = got._jdf.queryExecution().executedPlan()
        moved = plan.toString().count("Exchange hashpartitioning")
        assert {r.return_type for r in got.collect()} == {"Future<int>"}
    # classes and their relations; asked symbols, folded hovers and texts, in the two branches that a hover opens
    assert moved <= 8


def test_neighbourhood_of_repeats_and_open_ends(spark):
    nodes = spark.createDataFrame([("p", "A", None), ("p", "B", "A"), ("p", "B", "A"), ("q", "A", None)], "project_id string, node_id string, parent string")
    edges = spark.createDataFrame([
        ("p", "A", "B"), ("p", "A", "B"), ("p", "A", "A"), ("p", "A", None), ("p", None, "A"), ("p", None, None), ("q", "C", "A")],
        "project_id string, source string, target string")
    got = [tuple(r) for r in G.neighbourhood(nodes, edges, nodes.filter("parent is null").select("project_id", "node_id")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {
        ("p", "A", "member", "B"), ("p", "A", "successor", "B"), ("p", "A", "successor", "A"), ("p", "A", "predecessor", "A"),
        ("p", "A", "successor", None), ("p", "A", "predecessor", None), ("q", "A", "predecessor", "C")}


def test_a_range_is_two_rows_whatever_its_length(spark):
    ranges = spark.createDataFrame([(0, 0), (7, 7), (0, 2147483647), (3, 2147483646), (5, 300), (1, 2)], "lo bigint, hi bigint")
    got = sorted((r.n, r.lo, r.hi) for r in E._halves(ranges.withColumns({"l": F.col("lo"), "h": F.col("hi")})).groupBy("l", "h").agg(
        F.count("*").alias("n")).select("n", F.col("l").alias("lo"), F.col("h").alias("hi")).collect())
    assert got == [(1, 0, 0), (1, 7, 7), (2, 0, 2147483647), (2, 1, 2), (2, 3, 2147483646), (2, 5, 300)]


def test_line_owners_at_every_end(spark):
    rng = random.Random(5)
    far = 2147483647
    spans = [(lo, rng.choice([lo, lo + 1, lo + rng.randrange(70), far])) for lo in (rng.randrange(90) for _ in range(60))]
    spans += [(-1, 5), (9, 8), (far, far), (0, far)][:3]
    calls = spark.createDataFrame([("p", "f", f"n{i}", i, lo, hi) for i, (lo, hi) in enumerate(spans)],
                                  "project_id string, file_uri string, node_id string, ord int, sl int, el int")
    lines = [-1, *range(0, 170), far - 1, far]
    points = spark.createDataFrame([("p", "f", n) for n in lines + lines], "project_id string, file_uri string, line int")
    got = {r.line: r.node_id for r in E.line_owners(calls, points).collect()}
    want = {n: next((f"n{i}" for i, (lo, hi) in enumerate(spans) if 0 <= lo <= n <= hi), None) for n in lines}
    assert got == {n: w for n, w in want.items() if w}


def test_bodies_are_sliced_and_scanned_once(spark, monkeypatch):
    """Filters on bodies and on their names don't compute them anew."""
    plans = []
    monkeypatch.setattr(E, "mentions", lambda bodies, of=E.mentions: plans.append(of(bodies)) or plans[-1])
    found = code.code_mentions(spark, SF_DIR).count()
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert found > 0 and plan.count("(?=((?<!") == 1 and plan.count("[\\x{10000}") <= 8


def test_a_symbol_is_read_once(spark, monkeypatch):
    """One look per tree level takes all values of a symbol; values of odd types become what single looks make of them."""
    from codeloom.sources import symbols
    plans = []
    monkeypatch.setattr(symbols, "written", lambda df, of=symbols.written: plans.append(df) or of(df))
    odd = [{"name": 5, "kind": "6", "detail": None, "range": {"start": {"line": "3", "character": 1.7}, "end": 5}},
           {"name": {"a": 1}, "kind": True, "range": 7, "selectionRange": [1], "children": {}},
           {"name": "x", "kind": 99999999999, "detail": True, "range": {"start": {"line": None, "character": 2}}}, 3, None]
    tree = [{"name": "Top", "kind": 5, "range": {"start": {"line": 1, "character": 2}, "end": {"line": 3, "character": 4}}, "children": odd}]
    trees = spark.createDataFrame([("p", "u", json.dumps(tree))], "project_id string, file_uri string, tree string")
    rows = flatten_trees(trees).orderBy("sym_path").collect()
    assert [(r.name, r.kind, r.detail, r.rng and tuple(r.rng), r.sel_rng, r.n_children) for r in rows] == [
        ("Top", 5, "", (1, 2, 3, 4), None, 5), ("5", 6, "", (3, 1, None, None), None, 0), ('{"a":1}', 1, "", None, None, 0),
        ("x", None, "true", None, None, 0), (None, None, "", None, None, 0), (None, None, "", None, None, 0)]
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get(") == symbols.LEVELS
