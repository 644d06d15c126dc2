"""Column builders on hand-written cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from codeloom.functions import detectors, signatures as sig, symbols as S, text as T, verbs
from codeloom.functions.layers import layer
from codeloom.operators.nodes import FEATURES
from codeloom.sources import packages as P
from codeloom.sources.sinks import as_json_rows, sanitize_strings


def one(spark, build, **values):
    """Evaluate an expression over one row of string or int values."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(build(*[F.col(k) for k in values]).alias("x")).first()["x"]


@pytest.mark.parametrize("shown, base", [
    ("String", "String"), ("  User? ", "User"), ("List<User>", "User"), ("Future<List<User?>>", "User"),
    ("Map<String, User>", "User"), ("Map<String, List<User>>", "List<User>"), ("p.Type<X>", "Type<X>"),
    ("lib.User", "User"), ("final User", "User"), ("A<B<C<D<E<F<G>>>>>>", "G"), ("", None), (None, None), ("   ", ""),
])
def test_base_type_name(spark, shown, base):
    assert one(spark, T.base_type_name, t=shown) == base


def test_escape_regex(spark):
    assert one(spark, T.escape_regex, t=r"a.b*c[d]\e$") == r"a\.b\*c\[d\]\\e\$"


@pytest.mark.parametrize("code, clean", [
    ("a(); // b()\nc();", "a(); \nc();"),
    ("a /* b\n c */ d", "a  d"),
    ("x = 'it\\'s' + \"q\" + `z`;", "x =  +  + ;"),
    ("u = 'http://x'; y();", "u = 'http:"),
    ("open ' never closed", "open ' never closed"),
])
def test_strip_comments_and_strings(spark, code, clean):
    assert one(spark, T.strip_comments_and_strings, t=code) == clean


def test_strip_survives_very_long_literals(spark):
    long_text = "f('" + "\\'x" * 100_000 + "') + g()"
    assert one(spark, T.strip_comments_and_strings, t=long_text) == "f() + g()"


def test_sanitize_json(spark):
    raw = "a\x00b\x1f\x7f\r\nc\nd\re\tf\fg\bh<i>"
    assert one(spark, T.sanitize_json, t=raw) == "a\\u0000b\\u001f\\u007f\\nc\\nd\\re\\tf\\fg\\bh<i>"
    assert one(spark, T.sanitize_json, t=None) is None


def test_sanitize_reaches_nested_strings_and_keeps_nulls(spark):
    df = spark.createDataFrame(
        [(1, {"k": "a\tb"}, [("x\n", None)], None)], "n int, m map<string,string>, s array<struct<a:string,b:string>>, z struct<q:string>")
    row = sanitize_strings(df).first()
    assert row.m == {"k": "a\\tb"} and row.s[0].a == "x\\n" and row.s[0].b is None and row.z is None
    text = as_json_rows(spark.createDataFrame([("p", "<T>")], "project_id string, label string"), ["project_id"]).first()
    assert text.json == '{"label":"\\u003cT>"}'


@pytest.mark.parametrize("rng, text", [
    ((0, 0, 0, 3), "abc"), ((0, 4, 0, 1), "bcd"), ((0, 4, 1, 2), "ef\n\U0001F600"), ((0, 0, 2, 1), "abcdef\n\U0001F600xy\nz"),
    ((1, 2, 1, 4), "xy"), ((0, 0, 9, 0), ""), ((0, -5, 0, 2), "ab"), (None, ""),
])
def test_slice_range_counts_utf16(spark, rng, text):
    df = spark.createDataFrame([("abcdef\r\n\U0001F600xy\nz", rng)], "c string, r struct<sl:int,sc:int,el:int,ec:int>")
    assert df.select(T.slice_range(T.lines_of(F.col("c")), F.col("r")).alias("x")).first().x == text


def test_snippet_before(spark):
    code = "\n".join(str(i) for i in range(10))
    df = spark.createDataFrame([(code,)], "c string")
    got = df.select(*[T.snippet_before(T.lines_of(F.col("c")), F.lit(n)).alias(f"l{n}") for n in (0, 2, 7, 30)]).first()
    assert tuple(got) == ("0", "0\n1\n2", "2\n3\n4\n5\n6\n7", "")


def test_package_imports(spark):
    code = "import 'package:flutter/a.dart';\nimport \"package:http/b.dart\";\nimport 'package:flutter/c.dart';\nimport 'dart:core';\nimport '../x.dart';"
    assert one(spark, T.package_imports, t=code) == ["flutter", "http"]


@pytest.mark.parametrize("code, names", [
    ("foo(1); bar (2); x.y.z(3)", {"foo", "bar", "x.y.z", "y.z", "z"}),
    ("foo; bar", set()),
    ("a==(b); bool operator ==(o)", {"==", "operator ==", }),
    ("$x(1) a$b(2)", {"x", "a$b", "$b", "b"}),
])
def test_call_tokens(spark, code, names):
    assert set(one(spark, T.call_tokens, t=code)) == names


def test_call_tokens_equal_one_scan_of_the_whole_text(spark):
    """The words in front of parentheses tell as much as all characters do, in the same order."""
    rng = random.Random(5)
    bits = [*"ab_9$. \t\n()[]=+-ü\U0001F600'", "operator ", "operator", "foo(", " (", "((", "operator ==(", "\r\n", "\u00a0"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(3000)] + [None, "", "(", "xoperator ==(", "operator operator("]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.array_distinct(F.regexp_extract_all("t", F.lit(T.CALL_TOKEN), 1))
    assert df.select(whole.alias("a"), T.call_tokens(F.col("t")).alias("b")).filter("NOT (a <=> b)").count() == 0


def test_line_ends(spark):
    assert one(spark, T.lines_of, t="a\r\r\nb\n\nc\rd\r\n") == ["a\r", "b", "", "c\rd", ""]


def test_format_message(spark):
    def build(t, a, b):
        return T.format_message(t, a, b)
    assert one(spark, build, t="{0} and {1} ({0})", a="x", b="y") == "x and y ({0})"
    assert one(spark, build, t="no slots", a="x", b="y") == "no slots"


def test_ids(spark):
    def build(u, n, k, p):
        return S.node_id(u, n, k, p)
    assert one(spark, build, u="f", n="A", k=9, p="A") == "f#parent:A#kind:ctor#name:_default_"
    assert one(spark, build, u=None, n="m", k=99, p=None) == "unknown_uri#kind:k99#name:m"
    assert one(spark, S.kind_name, k=22) == "typedef" and one(spark, S.kind_name, k=1) == "kind_1"


def params(spark, detail):
    got = one(spark, sig.parameters, d=detail)
    return [(p.name, p.type, p.is_named, p.is_required, p.is_optional_positional) for p in got]


@pytest.mark.parametrize("detail, expected", [
    ("f(int a, String b)", [("a", "int", False, False, False), ("b", "String", False, False, False)]),
    ("({required this.a, this.b = const [1, 2]})", [("a", "self_field:a", True, True, False), ("b", "self_field:b", True, False, False)]),
    ("(int a, [List<int>? b, c])", [("a", "int", False, False, False), ("b", "List<int>?", False, False, True), (None, "c", False, False, True)]),
    ("(void Function(int, String) cb, {required Map<K, List<V>> m})",
     [("cb", "void Function(int, String)", False, False, False), ("m", "Map<K, List<V>>", True, True, False)]),
    ("(name)", [("name", "dynamic", False, False, False)]),
    ("(List<int>)", [(None, "List<int>", False, False, False)]),
    ("()", []),
    ("(covariant Base b,)", [("b", "Base", False, False, False)]),
    ("(int a, #bad, int c)", [("a", "int", False, False, False)]),
    ("(Map<A, B<C, D<E, F<G, H>>>> m, int z)", [("m", "Map<A, B<C, D<E, F<G, H>>>>", False, False, False), ("z", "int", False, False, False)]),
    ("({this.x = const [[1, 2], [3]], int y = 2})", [("x", "self_field:x", True, False, False), ("y", "int", True, False, False)]),
    ("(void Function(int Function(String Function(A, B), int)) cb, int z)",
     [("cb", "void Function(int Function(String Function(A, B), int))", False, False, False), ("z", "int", False, False, False)]),
])
def test_parameters(spark, detail, expected):
    assert params(spark, detail) == expected


def test_constructor_fallback(spark):
    # the sign makes the first entry unreadable, so the list gives nothing and every `this.x` counts
    assert params(spark, "({this.a #, this.b})") == []
    got = one(spark, sig.constructor_parameters, d="({this.a #, this.b})")
    assert [(p.name, p.type, p.is_named) for p in got] == [("a", "self_field:a", True), ("b", "self_field:b", True)]
    assert one(spark, sig.constructor_parameters, d="({x #, this.b})") == []


@pytest.mark.parametrize("detail, name, expected", [
    ("Future<int> load(int a)", "load", "Future<int>"), ("static void run()", "run", None), ("@Doc static int run()", "run", "int"),
    ("Map<String, int> m(x)", "m", "Map<String, int>"), ("run()", "run", None),
])
def test_return_type(spark, detail, name, expected):
    assert one(spark, sig.return_type, d=detail, n=name) == expected


def test_field_type(spark):
    assert one(spark, sig.field_type, d="@Doc late final Map<String, int> x = {}") == "Map<String, int>"
    assert one(spark, sig.field_type, d="x") is None


def test_hover_types(spark):
    assert one(spark, sig.hover_field_type, t="```dart\nfinal List<int> items\n```", n="items") == "List<int>"
    assert one(spark, sig.hover_return_type, t="```dart\nstatic Future<A> go (int x)\n```", n="go") == "Future<A>"


@pytest.mark.parametrize("snippet, name, expected", [
    ("class A {\n  @override\n  final List<int> xs;", "xs", "List<int>"),
    ("}\n\n  String name = 'a';", "name", "String"),
    ("  int other;", "xs", None),
    ("word " * 600 + "\nint xs;", "xs", "int"),
    ("word " * 600 + "List<int> xs;", "xs", "List<int>"),
    ("word " * 600 + ";\n  late int xs;", "xs", "late int"),
])
def test_snippet_field_type(spark, snippet, name, expected):
    assert one(spark, sig.snippet_field_type, s=snippet, n=name) == expected


@pytest.mark.parametrize("snippet, name, expected", [
    ("{\n  @override\n  Widget build(BuildContext c) {", "build", "Widget"),
    ("{\n  void run() {", "run", None),
    ("{\n  static Future<int> go() async {", "go", "static Future<int>"),
])
def test_snippet_return_type(spark, snippet, name, expected):
    assert one(spark, sig.snippet_return_type, s=snippet, n=name) == expected


def test_snippet_is_searched_once(spark):
    df = spark.createDataFrame([("  @override\n  final int x;", "x")], "s string, n string")
    plan = df.select(sig.snippet_field_type(F.col("s"), F.col("n")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?s)^(.*?\S)\s+") == 1


def test_class_header_is_searched_once(spark):
    """Whether a header bounds its type parameters is asked once, not by every clause and every step of its list."""
    df = spark.createDataFrame([("class A<T extends B> extends C<D, E> implements F",)], "d string")
    found = df.select(sig.class_relations(F.col("d")).alias("r"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(sig._BOUNDED) == 1 and plan.count(r"(?<!\w)extends\s+(.+?)") == 1
    assert found.select("r.*").first() == (["C<D, E>"], [], ["F"])


@pytest.mark.parametrize("above, expected", [
    ("  @A(1)", "int"), ("  @A(\n 1 )  ", "int"), ("  foo() {}", "final int"), ("  word\t\x0b", "int"), ("  };", "final int"),
    ("", "final int"), ("  A(1)", "final int"), ("  @A((1))", "final int"),
])
def test_line_goes_on_after(spark, above, expected):
    assert one(spark, sig.snippet_field_type, s=f"{above}\n  final int x;", n="x") == expected


def test_class_relations(spark):
    got = one(spark, sig.class_relations, d="class A<T extends X> extends B<T, Map<K, V>> with M, N<int> implements I<A, B>, J {")
    assert (got["extends"], got["with"], got["implements"]) == (["B<T, Map<K, V>>"], ["M", "N<int>"], ["I<A, B>", "J"])
    deep = "class A<T extends B<C<D<E<F>>>>> extends G<H<I<J<K, L>>>> implements M<N<O<P<Q, R>>>>, S"
    got = one(spark, sig.class_relations, d=deep)
    assert (got["extends"], got["implements"]) == (["G<H<I<J<K, L>>>>"], ["M<N<O<P<Q, R>>>>", "S"])
    got = one(spark, sig.class_relations, d="class A")
    assert (got["extends"], got["with"], got["implements"]) == ([], [], [])


# one case per layer rule, in rule order: name, kind, bases, member counts, layer
LAYER_CASES = [
    ("run", 6, [], {}, "member"),
    ("A", 5, ["statelesswidget"], {}, "view"),
    ("A", 5, [], {"methods": 1, "build_methods": 1}, "view"),
    ("A", 5, ["mycomponentx"], {}, "view"),
    ("HomeDrawer", 5, [], {}, "view"),
    ("PageRoute", 5, [], {}, "view"),
    ("A", 5, ["cubit"], {}, "state"),
    ("A", 5, [], {"fields": 1, "state_fields": 1, "methods": 1, "event_methods": 1}, "state"),
    ("FileManager", 5, [], {}, "state"),
    ("StateThing", 5, [], {}, "state"),
    ("A", 5, [], {"methods": 2, "async_methods": 1, "business_methods": 2}, "service"),
    ("A", 5, ["baseclientx"], {}, "service"),
    ("ClickHandler", 5, [], {}, "service"),
    ("ApiCall", 5, [], {}, "service"),
    ("A", 5, [], {"fields": 1, "methods": 2, "business_methods": 2}, "model"),
    ("OrderEvent", 5, [], {}, "model"),
    ("DataBag", 5, [], {}, "model"),
    ("Color", 10, [], {}, "model"),
    ("DateUtils", 5, [], {}, "utility"),
    ("A", 5, [], {"methods": 3, "static_methods": 3, "business_methods": 3}, "utility"),
    ("A", 5, [], {"fields": 1, "methods": 3, "business_methods": 3}, "utility"),
]


def test_layer_rules(spark):
    rows = [(i, n, k, b, tuple(f.get(x, 0) for x in FEATURES)) for i, (n, k, b, f, _) in enumerate(LAYER_CASES)]
    schema = "i int, name string, kind int, bases array<string>, feats struct<" + ",".join(f"{x}:bigint" for x in FEATURES) + ">"
    got = spark.createDataFrame(rows, schema).select(
        "i", layer(F.col("name"), F.col("kind"), F.col("bases"), F.col("feats")).alias("layer")).collect()
    assert [r.layer for r in sorted(got)] == [c[-1] for c in LAYER_CASES]


def test_smart_verbs(spark):
    cases = [
        ("reads-from", "view", "state", "X", "verb.reactsTo"), ("calls", "view", "state", "X", "verb.reactsTo"),
        ("instance-of", "view", "view", "X", "verb.buildsAndShows"), ("calls", "state", "service", "X", "verb.delegates"),
        ("reads-from", "state", "model", "X", "verb.managesState"), ("instance-of", "service", "model", "X", "verb.assembles"),
        ("calls", "model", "model", "X", "verb.composedOf"), ("calls", "utility", "view", "MyAnalytics", "verb.reportsEvent"),
        ("calls", "utility", "view", "AlertBox", "verb.showsUser"), ("calls", "utility", "view", "DateFormatter", "verb.formats"),
        ("extends", "utility", "view", "X", "verb.extends"), ("passes-as-argument", "utility", "view", "X", "verb.unknown"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, l string, s string, t string, n string, want string")
    got = df.select("i", verbs.smart_verb(F.col("l"), F.col("s"), F.col("t"), F.col("n")).alias("v"), "want").collect()
    assert [r.v for r in sorted(got)] == [c[-1] for c in cases]


SPEC = """name: app
# mine: in a comment
dependencies:
  mine:
    path: ../mine
  "quoted":

    # between
    path: ../q
  far:
    git:
      path: sub
  inline: {path: ../x}
  both: ^1
    path: no
dev_dependencies:\r
  lints: ^1\r
  deep:\r
    hosted: u\r
dependency_overrides:
    wide:
        path: ../wide
flutter:
  uses-material-design: true
"""


def test_package_types(spark):
    cases = [("app", "/w/app", "custom"), ("sub", "/w/app/sub", "custom"), ("mine", "/x/mine", "custom"), ("quoted", "/x", "custom"),
             ("lints", "/x/lints", "custom"), ("deep", "/x", "custom"), ("wide", "/x", "custom"),
             ("hosted", "/x", "third_party"), ("far", "/x", "third_party"), ("git", "/x", "third_party"), ("inline", "/x", "third_party"),
             ("both", "/x", "third_party"), ("ine", "/x", "third_party"), ("ints", "/x", "third_party"),
             ("flutter", "/x/f", "flutter_official"), ("flutter_x", "/x/f", "flutter_official"), ("material", "/x/m", "flutter_official"),
             ("core", "/opt/dart-sdk/c", "sdk"), ("http", "/w/app2", "third_party"),
             ("c++(", "/x/cpp", "third_party"), ("l.nts", "/x/l", "third_party"), ("min+", "/x/m", "third_party")]
    packages = spark.createDataFrame([("p", *c) for c in cases] + [("other", "mine", "/x", "third_party"), ("none", "mine", "/x", "third_party")],
                                     "project_id string, name string, path string, want string")
    projects = spark.createDataFrame([("p", "/w/app", SPEC), ("other", "/w/o", None), ("last", "/w", "a:\n  b:\n    path: x")],
                                     "project_id string, root string, root_spec string")
    got = P.classify(packages, projects)
    assert got.columns == [*packages.columns, "type"]
    rows = got.collect()
    assert len(rows) == len(cases) + 2 and {r.name for r in rows if r.type != r.want} == set()
    entries = {(r.section, r.key, r.has_path) for r in P.descriptor_entries(projects.filter("project_id = 'last'")).collect()}
    assert entries == {("a", "b", True)}


def test_no_descriptor_text_after_the_parse(spark):
    packages = spark.createDataFrame([("p", "a", "/a")], "project_id string, name string, path string")
    projects = spark.createDataFrame([("p", "/w", SPEC)], "project_id string, root string, root_spec string")
    plan = P.classify(packages, projects)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("regexp_extract_all", 1)
    # a join carries neither the descriptor nor its lines
    for line in plan.split("\n"):
        assert "Join" not in line or "root_spec" not in line
    assert "Aggregate" in above


def test_paths(spark):
    assert one(spark, P.normalize_path, p="/a/./b//../c/..") == "/a"
    assert one(spark, P.uri_path, p="file:///a%20b+c") == "/a b+c"


def test_detectors(spark):
    src = "if (x.isEmpty) { throw BadException(); } switch (y) {} return new Box(); emit(1); a.b(); c.d(); e.f(); g.h(); await z; assert(q); s.length >= 3; null check; w ? 1 : 2"
    df = spark.createDataFrame([(src, "method")], "s string, k string")
    s = F.col("s")
    row = df.select(detectors.responsibilities(s, F.col("k")).alias("r"), detectors.decisions(s).alias("d"),
                    detectors.validations(s).alias("v"), detectors.collaborations(s).alias("c")).first()
    assert row.r == ["responsibilities.createsObjects", "responsibilities.managesState", "responsibilities.validatesInput"]
    assert len(row.d) == 4 and len(row.v) == 4
    assert row.c == ["collaborations.intensiveCollaboration", "collaborations.coordinatesAsync"]


def split_by_stack(text):
    """Commas outside all pairs cut. A pair holds only whole pairs; a closing sign of another kind pairs nothing before it."""
    pairs, stack, match = {")": "(", ">": "<", "]": "[", "}": "{"}, [], {}
    for i, c in enumerate(text):
        if c in pairs.values():
            stack.append(i)
        elif c in pairs:
            if stack and text[stack[-1]] == pairs[c]:
                match[stack.pop()] = i
            else:
                stack.clear()
    out, part, i = [], "", 0
    while i < len(text):
        if i in match:
            part += text[i:match[i] + 1]
            i = match[i] + 1
            continue
        if text[i] == ",":
            out.append(part)
            part = ""
        else:
            part += text[i]
        i += 1
    return [p.strip() for p in [*out, part] if p.strip()]


def test_lists_split_like_a_stack(spark):
    rnd = random.Random(11)
    texts = ["", ",", ",,a", "a<b,c", "a>b,(c,d)", "(a,b", "a,b)", "<(>,)", "((((((a,b),c),d),e),f),g),h", "{[(<a,b>),c],d},e", "=> x, (a, b)"]
    texts += ["".join(rnd.choice("ab,,()<>[]{} ") for _ in range(rnd.randrange(1, 24))) for _ in range(1500)]
    for _ in range(300):  # whole pairs, nested at random
        t = "a,b"
        for _ in range(rnd.randrange(9)):
            o, c = rnd.choice(["()", "<>", "[]", "{}"])
            t = rnd.choice(["", "x,", "y"]) + o + t + c + rnd.choice(["", ",z", " w"])
        texts.append(t)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", sig.split_list(F.col("t")).alias("x")).collect():
        assert row.x == split_by_stack(row.t), row.t


def test_long_parameter_lists_take_linear_time(spark):
    def seconds(n, build):
        detail = "f(" + ", ".join(build(i) for i in range(n)) + ")"
        df = spark.createDataFrame([(detail,)], "d string").select(F.size(sig.parameters(F.col("d"))).alias("n"))
        assert df.first()["n"] == n
        times = []
        for _ in range(2):
            start = time.perf_counter()
            df.first()
            times.append(time.perf_counter() - start)
        return min(times)
    shapes = [lambda i: f"Map<String, List<int>> p{i}", lambda i: f"Map<A, B<C, D<E, F<G, H{i}>>>> p{i}", lambda i: f"int p{i}"]
    for shape in shapes:
        assert seconds(1600, shape) < seconds(1, shape) + 1.0
