"""Text queries over documents, pages, conversations and nations."""

from functools import reduce

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.detectors import condition_count, switch_count
from codeloom.operators import edges as E, enrich as R, graph as G, semantics as M, views as V
from codeloom.plans import bindings as B
from codeloom.sources.messages import builtin_messages, choose_language, with_template
from codeloom.sources.sinks import sanitize_strings

SECTIONS = ["responsibilities", "decisions", "validations", "collaborations"]


def escaped_text(spark, d):
    return B.table(spark, d, "documents").select("doc_id", "text").select("doc_id", F.md5(T.escape_regex(F.col("text"))).alias("digest"))


def cleaned_source(spark, d):
    clean = T.strip_comments_and_strings(F.col("code"))
    return B.code_documents(spark, d).select("doc_id", F.md5(clean).alias("digest"), F.length(clean).alias("n_chars"))


# fixed values: words replaced by control characters
CONTROL_WORDS = [(" de ", 1), (" the ", 9), (" of ", 127), (" and ", 8), (" is ", 12), (" in ", 31), (" la ", 13), (" en ", 11)]


def _with_controls(c):
    return reduce(lambda s, w: F.replace(s, F.lit(w[0]), F.lit(chr(w[1]))), CONTROL_WORDS, c)


def sanitized_text(spark, d):
    safe = T.sanitize_json(_with_controls(F.col("text")))
    return B.table(spark, d, "documents").select("doc_id", "text").select("doc_id", F.md5(safe).alias("digest"), F.length(safe).alias("n_chars"))


def sanitized_turns(spark, d):
    """Strings inside an array of structs and a map are escaped as well."""
    said = _with_controls(F.col("text"))
    nested = B.table(spark, d, "conversations").select(
        "conv_id", "turn", F.struct(F.col("role"), F.array(F.struct(said.alias("said"), F.col("turn").alias("at"))).alias("parts"),
                                    F.create_map(F.col("role"), said).alias("by_role")).alias("message"))
    return sanitize_strings(nested).select(
        "conv_id", "turn", F.col("message.role").alias("role"), F.col("message.parts")[0]["said"].alias("said"),
        F.col("message.parts")[0]["at"].alias("at"), F.md5(F.try_element_at("message.by_role", F.col("message.role"))).alias("mapped"))


def _doc_files(spark, d):
    return B.code_documents(spark, d).select("project_id", "file_uri", F.col("code").alias("content"))


def _doc_ranges(spark, d):
    """Five ranges per document: single line, multi-line, moving, swapped columns, and past the end."""
    n = (F.col("doc_id") % 9).cast("int")
    def rng(sl, sc, el, ec):
        return F.struct(*[(F.lit(v) if isinstance(v, int) else v).alias(c) for v, c in zip((sl, sc, el, ec), ("sl", "sc", "el", "ec"))])
    ranges = F.array(rng(0, 0, 0, 12), rng(1, 3, 4, 5), rng(n, 2, n + 2, 4), rng(0, 9, 0, 4), rng(3, 0, 500, 1))
    return B.code_documents(spark, d).select("project_id", "file_uri", "doc_id", F.posexplode(ranges).alias("slot", "rng")).withColumn(
        "sel_rng", F.col("rng"))


def document_slices(spark, d):
    return R.slice_bodies(_doc_ranges(spark, d), _doc_files(spark, d)).select("doc_id", "slot", "body")


def document_snippets(spark, d):
    rows = B.code_documents(spark, d).select("project_id", "file_uri", "doc_id", (F.col("doc_id") % 12).cast("int").alias("line"))
    found = R.with_file_text(rows, _doc_files(spark, d), lambda lines: T.snippet_before(lines, F.col("line")), "snippet")
    return found.select("doc_id", "snippet")


def document_imports(spark, d):
    return V.file_imports(_doc_files(spark, d)).select("file_uri", "package")


def node_imports(spark, d):
    """Packages imported by the file of each labelled document."""
    nodes = B.table(spark, d, "labels").select("doc_id", B.text("node:", F.col("doc_id")).alias("node_id"))
    placed = nodes.join(B.code_documents(spark, d).select("doc_id", "project_id", "file_uri"), "doc_id")
    return V.node_imports(placed, V.file_imports(_doc_files(spark, d)))


def import_roles(spark, d):
    """Imports of each document split into the project's own and external packages."""
    projects = B.table(spark, d, "documents").select(F.col("source").alias("project_id")).distinct()
    own = F.length("project_id") == 4
    packages = projects.select("project_id", F.lit("for_kit").alias("name"), F.when(own, "custom").otherwise("third_party").alias("type"))
    nodes = B.code_documents(spark, d).select("project_id", "file_uri", F.col("file_uri").alias("node_id"))
    return G.package_uses(V.node_imports(nodes, V.file_imports(_doc_files(spark, d))), packages)


def page_links(spark, d):
    return B.table(spark, d, "pages").select("page_id", F.explode(T.link_targets(F.col("html"))).alias("target"))


def page_calls(spark, d):
    pages = B.table(spark, d, "pages").select("page_id", "html").select(
        F.lit("web").alias("project_id"), F.col("page_id").alias("source"), F.col("html").alias("body"))
    return E.mentions(pages).select(F.col("source").alias("page_id"), "name")


def _profiles(spark, d):
    return M.semantic_profile(B.code_documents(spark, d).select("doc_id", "file_uri", "kind", F.col("code").alias("body")))


def semantic_profiles(spark, d):
    return _profiles(spark, d).select(
        "doc_id", *[F.array_join(F.col(f"profile.{s}"), ",").alias(s) for s in SECTIONS])


def profile_counts(spark, d):
    return M.profile_counts(_profiles(spark, d)).drop("file_uri", "kind")


def decision_counts(spark, d):
    code = F.col("code")
    return B.code_documents(spark, d).select(
        "doc_id", condition_count(code).alias("n_conditions"), switch_count(code).alias("n_switches"))


def nation_phrases(spark, d):
    """Messages of the nation catalogue in Spanish, English where Spanish is open, filled per customer."""
    chosen = choose_language(B.nation_messages(spark, d), "es")
    customers = B.table(spark, d, "customer").join(B.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    phrase = T.format_message(F.col("template"), F.col("c_name"), F.col("c_mktsegment"))
    return customers.join(chosen, F.col("n_name") == F.col("key")).select("c_custkey", phrase.alias("phrase"))


def event_messages(spark, d):
    """Unknown keys stand for themselves."""
    key = F.when(F.col("event_type") == "click", "verb.calls").when(
        F.col("event_type") == "view", "decisions.businessCases").otherwise(F.concat(F.lit("event."), F.col("event_type")))
    rows = B.table(spark, d, "events").withColumn("message", key)
    told = with_template(rows, builtin_messages(), "es", "message", "template")
    return told.select("event_id", T.format_message(F.col("template"), F.col("user_id").cast("string")).alias("phrase"))


# --- SQL twins: the same rules, said for the checking engine -------------------------
def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chain(expr: str, pairs) -> str:
    return reduce(lambda e, p: f"replace({e}, {p[0]}, {p[1]})", pairs, expr)


_CODE = _chain("text", [(_q(a), _q(b)) for a, b in B.CODE_WORDS])
DOCS = f"""docs AS (SELECT doc_id, source AS project_id, 'doc:' || doc_id AS file_uri,
    CASE WHEN doc_id % 2 = 0 THEN 'method' ELSE 'function' END AS kind, {_CODE} AS code FROM documents),
  lined AS (SELECT *, string_split_regex(code, '\\r?\\n') AS ls FROM docs)"""
_NO_LINE = "regexp_replace(code, '//[^\\n\\r]*', '', 'g')"
_NO_BLOCK = f"regexp_replace({_NO_LINE}, '(?s)/\\*.*?\\*/', '', 'g')"


def _literals() -> str:
    return "|".join(rf"{q}[^{q}\\]*(?:\\.[^{q}\\]*)*{q}" for q in ('"', "'", "`")).replace("'", "''")


_CLEAN = f"regexp_replace({_NO_BLOCK}, '{_literals()}', '', 'g')"
_CONTROLLED = _chain("text", [(_q(w), f"chr({c})") for w, c in CONTROL_WORDS])
_CONTROL_ESCAPES = [(f"chr({c})", f"'\\u{c:04x}'") for c in (1, 11, 31, 127)] + [
    ("chr(13) || chr(10)", "'\\n'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'"), ("chr(12)", "'\\f'"), ("chr(8)", "'\\b'")]
_SAFE = _chain(_CONTROLLED, _CONTROL_ESCAPES)


def _slice(sl, sc, el, ec) -> str:
    return f"""CASE WHEN {sl} >= len(ls) OR {el} >= len(ls) THEN ''
      WHEN {sl} = {el} THEN substring(ls[{sl} + 1], least({sc}, {ec}) + 1, abs({ec} - {sc}))
      ELSE substring(ls[{sl} + 1], {sc} + 1) || chr(10)
        || CASE WHEN {el} - {sl} > 1 THEN array_to_string(ls[{sl} + 2:{el}], chr(10)) || chr(10) ELSE '' END
        || substring(ls[{el} + 1], 1, {ec}) END"""


_N = "(doc_id % 9)::INT"
_SLICES = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS slot, {_slice(*r)} AS body FROM lined"
    for i, r in enumerate([("0", "0", "0", "12"), ("1", "3", "4", "5"), (_N, "2", f"({_N} + 2)", "4"), ("0", "9", "0", "4"), ("3", "0", "500", "1")]))


def _keys(*rules) -> str:
    cells = ", ".join(f"CASE WHEN {cond} THEN '{key}' END" for cond, key in rules)
    return f"array_to_string(list_filter([{cells}], lambda x: x IS NOT NULL), ',')"


def _m(pattern: str) -> str:
    return f"regexp_matches(code, '{pattern}')"


def _has(part: str) -> str:
    return f"contains(code, '{part}')"


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(code, '{pattern}'))"


_PROFILE = f"""WITH {DOCS}, p AS (SELECT doc_id,
  {_keys((f"kind = 'method' AND {_has('return ')} AND " + _m(r'return\s+\w+\.\w+'), 'responsibilities.transformsData'),
         (f"kind = 'method' AND {_has('return ')} AND " + _m(r'return\s+new\s+\w+'), 'responsibilities.createsObjects'),
         (f"{_has('setState')} OR {_has('emit(')}", 'responsibilities.managesState'),
         (f"{_has('Navigator.')} OR {_has('context.go')}", 'responsibilities.controlsNavigation'),
         (_m(r'http\.|client\.|api\.'), 'responsibilities.communicatesWithServices'),
         (f"{_has('validate')} OR " + _m(r'if\s*\([^)]*\.isEmpty'), 'responsibilities.validatesInput'))} AS responsibilities,
  {_keys((_count(r'if\s*\([^)]+\)') + ' > 0', 'decisions.conditionalDecisions'),
         (_count(r'switch\s*\([^)]+\)') + ' > 0', 'decisions.businessCases'),
         (f"{_has('? ')} AND {_has(': ')}", 'decisions.ternaryOperators'),
         (_m(r'throw\s+\w+Exception'), 'decisions.throwsExceptions'))} AS decisions,
  {_keys((_m(r'\.isEmpty|\.isNotEmpty'), 'validations.checksEmpty'),
         (_m(r'\.length\s*[<>]=?\s*\d'), 'validations.checksLength'),
         (f"{_has('assert(')} OR {_has('require(')}", 'validations.preconditions'),
         (_m(r'(?i)\bnull\b.*check|\bcheck.*\bnull\b'), 'validations.preventsNull'))} AS validations,
  {_keys((_count(r'\.\w+\(\)') + ' > 3', 'collaborations.intensiveCollaboration'),
         (_has('await '), 'collaborations.coordinatesAsync'),
         (f"{_has('listen')} OR {_has('stream')}", 'collaborations.listensReactively'))} AS collaborations
  FROM docs)"""

_SIZE = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, ',')) END::INT AS n_{0}"
_HTML_CLEAN = _CLEAN.replace("(code,", "(html,")

QUERIES = {
    "escaped_text": (escaped_text, r"""SELECT doc_id, md5(regexp_replace(text, '([.*+?^${}()|\[\]\\])', '\\\1', 'g')) AS digest FROM documents"""),
    "cleaned_source": (cleaned_source, f"""WITH {DOCS}, c AS (SELECT doc_id, {_CLEAN} AS clean FROM docs)
        SELECT doc_id, md5(clean) AS digest, length(clean)::INT AS n_chars FROM c"""),
    "sanitized_text": (sanitized_text, f"""WITH s AS (SELECT doc_id, {_SAFE} AS safe FROM documents)
        SELECT doc_id, md5(safe) AS digest, length(safe)::INT AS n_chars FROM s"""),
    "sanitized_turns": (sanitized_turns, f"""SELECT conv_id, turn, role, {_SAFE} AS said, turn AS at, md5({_SAFE}) AS mapped FROM conversations"""),
    "document_slices": (document_slices, f"WITH {DOCS} {_SLICES}"),
    "document_snippets": (document_snippets, f"""WITH {DOCS} SELECT doc_id,
        array_to_string(ls[greatest((doc_id % 12)::INT - 5, 0) + 1:least(len(ls), (doc_id % 12)::INT + 1)], chr(10)) AS snippet FROM lined"""),
    "document_imports": (document_imports, f"""WITH {DOCS} SELECT file_uri,
        unnest(list_distinct(regexp_extract_all(code, 'import\\s+[''"]package:(\\w+)/', 1))) AS package FROM docs"""),
    "node_imports": (node_imports, f"""WITH {DOCS} SELECT project_id, 'node:' || doc_id AS node_id,
        unnest(list_distinct(regexp_extract_all(code, 'import\\s+[''"]package:(\\w+)/', 1))) AS package FROM docs JOIN labels USING (doc_id)"""),
    "import_roles": (import_roles, f"""WITH {DOCS}, i AS (SELECT project_id, file_uri AS node_id,
          unnest(list_distinct(regexp_extract_all(code, 'import\\s+[''"]package:(\\w+)/', 1))) AS package FROM docs)
        SELECT project_id, node_id, package, CASE WHEN package = 'for_kit' AND length(project_id) = 4 THEN 'own_import' ELSE 'external_import' END AS role FROM i"""),
    "page_links": (page_links, """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS target FROM pages"""),
    "page_calls": (page_calls, f"""WITH c AS (SELECT page_id, {_HTML_CLEAN} AS clean FROM pages)
        SELECT DISTINCT page_id, unnest(regexp_extract_all(clean, '\\b(\\w[\\w$.]*)\\s*\\(', 1)) AS name FROM c
        UNION SELECT page_id, unnest(regexp_extract_all(clean, '\\w([^\\w\\s()]+)\\s*\\(', 1)) FROM c"""),
    "semantic_profiles": (semantic_profiles, f"{_PROFILE} SELECT * FROM p"),
    "profile_counts": (profile_counts, f"{_PROFILE} SELECT doc_id, {', '.join(_SIZE.format(s) for s in SECTIONS)} FROM p"),
    "decision_counts": (decision_counts, f"""WITH {DOCS} SELECT doc_id, {_count(r'if\s*\([^)]+\)')}::INT AS n_conditions,
        {_count(r'switch\s*\([^)]+\)')}::INT AS n_switches FROM docs"""),
    "nation_phrases": (nation_phrases, """SELECT c_custkey, CASE WHEN n_regionkey < 3 THEN c_mktsegment || ': ' || c_name || ' comercia con ' || n_name
        ELSE c_name || ' trades with ' || n_name || ' for ' || c_mktsegment || ' ({0})' END AS phrase
        FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    "event_messages": (event_messages, """SELECT event_id, CASE event_type WHEN 'click' THEN 'Envía un mensaje a'
        WHEN 'view' THEN 'Maneja ' || user_id || ' caso(s) de negocio' ELSE 'event.' || event_type END AS phrase FROM events"""),
}
