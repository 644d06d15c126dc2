"""Types, parameters and relations of symbols: header and detail first, then hover, then source text."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import signatures as sig
from codeloom.functions.symbols import access, is_sdk_uri
from codeloom.functions.text import base_type_name, lines_of, slice_range, snippet_before
from codeloom.schemas import KIND_CLASS, KIND_CONSTRUCTOR, KIND_ENUM, KIND_TYPEDEF

FILE_KEYS = ["project_id", "file_uri"]
def with_file_text(rows: DataFrame, files: DataFrame, read: Callable[[Column], Column], out: str) -> DataFrame:
    """Add read(lines) of each row's file; `read` may use the row's own columns. Rows of unknown files see null lines.

    The lines of a file are split once and meet its rows in one equi-join, so a file travels once to a task however
    many rows ask for it; a file with most of the rows is split over tasks by the adaptive skew join. `read` is made of
    expressions that compile into the join's own stage, so that a row gets what it reads and never a copy of the lines.
    """
    texts = files.select(*FILE_KEYS, lines_of(F.col("content")).alias("_lines"))
    return rows.join(texts, FILE_KEYS, "left").select(*rows.columns, read(F.col("_lines")).alias(out))


def slice_bodies(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Add `body`, the text of each symbol's range (selection range when it has none)."""
    def body(lines: Column) -> Column:
        return F.coalesce(slice_range(lines, F.coalesce("rng", "sel_rng")), F.lit(""))
    return with_file_text(symbols, files, body, "body")


def with_basics(symbols: DataFrame) -> DataFrame:
    """Access and SDK flag; symbols without a selection range stay as they are."""
    known = F.col("sel_rng").isNotNull()
    return symbols.withColumns({
        "access": F.when(known, access(F.col("name"))),
        "is_sdk": F.when(known, is_sdk_uri(F.col("file_uri"))),
    })


def _class_key(name):
    return F.trim(F.substring_index(name, "<", 1))


def attach_relations(symbols: DataFrame) -> DataFrame:
    """Add `relations` to class symbols, found by file and class name without type arguments; only these are dealt out."""
    is_class = F.coalesce(F.col("kind") == KIND_CLASS, F.lit(False))
    classes = symbols.filter(is_class)
    declared = (
        classes.filter(F.col("detail") != "")
        .select(*FILE_KEYS, _class_key(F.col("name")).alias("class_name"), "ord",
                sig.class_relations(F.col("detail")).alias("relations"))
        .groupBy(*FILE_KEYS, "class_name").agg(F.max_by("relations", "ord").alias("relations"))
    )
    found = classes.withColumn("class_name", _class_key(F.col("name"))).join(
        declared, [*FILE_KEYS, "class_name"], "left").drop("class_name")
    return found.unionByName(symbols.filter(~is_class), allowMissingColumns=True)


def detail_evidence(symbols: DataFrame) -> DataFrame:
    """Add what the detail text tells: detail_type, detail_params, detail_return."""
    detail, name, kind = F.col("detail"), F.col("name"), F.col("kind")
    field = sig.is_field(kind)
    called = ~field & detail.rlike(r"(?s)\(.*\)")
    ctor = kind == KIND_CONSTRUCTOR
    return symbols.withColumns({
        "detail_type": F.when(field, sig.field_type(detail)),
        "detail_params": F.when(called & ctor, sig.constructor_parameters(detail)).when(called, sig.parameters(detail)),
        "detail_return": F.when(called & ~ctor, sig.return_type(detail, name, keep_void=True)),
    })


def _no_params(c: str):
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def _asks_hover(kind: Column) -> Column:
    return ((sig.is_field(kind) & F.col("detail_type").isNull()) | (sig.is_plain_callable(kind) & F.col("detail_return").isNull())
            | ((kind == KIND_CONSTRUCTOR) & _no_params("detail_params")))


def hover_evidence(symbols: DataFrame, hovers: DataFrame) -> DataFrame:
    """Add hover_type, hover_return, hover_params for symbols the detail left open."""
    kind, name, text = F.col("kind"), F.col("name"), F.col("hover")
    answers = (
        hovers.filter(F.size("contents") > 0)
        .groupBy(*FILE_KEYS, F.col("line").alias("_l"), F.col("character").alias("_c"))
        .agg(F.min(F.array_join("contents", "\n")).alias("hover"))
    )
    return (
        symbols.withColumns({"_l": F.col("sel_rng.sl"), "_c": F.col("sel_rng.sc")})
        .join(answers, [*FILE_KEYS, "_l", "_c"], "left")
        .withColumns({
            "hover_type": F.when(
                sig.is_field(kind) & F.col("detail_type").isNull(), sig.hover_field_type(text, name)),
            "hover_return": F.when(
                sig.is_plain_callable(kind) & F.col("detail_return").isNull(), sig.hover_return_type(text, name, keep_void=True)),
            "hover_params": F.when(
                (kind == KIND_CONSTRUCTOR) & _no_params("detail_params"), sig.own_field_params(text, None)),
        })
        .drop("hover", "_l", "_c")
    )


def source_evidence(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Add source_type and source_return for fields and callables still without a type; only these meet the text, once."""
    kind, name, snippet = F.col("kind"), F.col("name"), F.col("_snippet")
    open_field = sig.is_field(kind) & F.coalesce("detail_type", "hover_type").isNull()
    open_call = sig.is_plain_callable(kind) & F.coalesce("detail_return", "hover_return").isNull()
    asked = F.coalesce(open_field | open_call, F.lit(False))
    read = with_file_text(symbols.filter(asked), files, lambda lines: snippet_before(lines, F.col("sel_rng.sl")), "_snippet")
    found = read.withColumns({
        "source_type": F.when(sig.is_field(kind), sig.snippet_field_type(snippet, name)),
        "source_return": F.when(~sig.is_field(kind), sig.snippet_return_type(snippet, name))}).drop("_snippet")
    return found.unionByName(symbols.filter(~asked), allowMissingColumns=True)


def settle_evidence(symbols: DataFrame) -> DataFrame:
    """One value per fact, in the order detail, hover, source text."""
    params = F.when(_no_params("detail_params"), F.coalesce("hover_params", "detail_params")).otherwise(F.col("detail_params"))
    # a void that detail or hover declares settles the question; the type itself is none
    returned = F.coalesce("detail_return", "hover_return", "source_return")
    return (
        symbols.withColumns({
            "resolved_type": F.coalesce("detail_type", "hover_type", "source_type"),
            "return_type": F.when(F.lower(returned) != "void", returned),
            "params": params,
        })
        .drop("detail_type", "hover_type", "source_type", "detail_return", "hover_return", "source_return",
              "detail_params", "hover_params")
    )


def enrich(symbols: DataFrame, files: DataFrame, hovers: DataFrame) -> DataFrame:
    """All evidence steps on the flat symbol table. Symbols without a selection range keep no evidence.

    Only symbols that the detail leaves open meet hovers, and of these the open ones the text; classes are never among them.
    """
    skipped = F.col("sel_rng").isNull()
    known = detail_evidence(with_basics(symbols.filter(~skipped)))
    asks = F.coalesce(_asks_hover(F.col("kind")), F.lit(False))
    asked = source_evidence(hover_evidence(known.filter(asks), hovers), files)
    full = settle_evidence(asked.unionByName(attach_relations(known.filter(~asks)), allowMissingColumns=True))
    return full.unionByName(symbols.filter(skipped), allowMissingColumns=True)


def type_definitions(symbols: DataFrame) -> DataFrame:
    """First top-level class, enum or typedef of every name in a project."""
    return (
        symbols.filter((F.col("depth") == 1) & F.col("kind").isin(KIND_CLASS, KIND_ENUM, KIND_TYPEDEF))
        .groupBy("project_id", "name").agg(
            F.min_by(F.struct("name", "file_uri", "kind", "sel_rng"), "ord").alias("definition"))
        .withColumnRenamed("name", "base_name")
    )


def resolve_types(uses: DataFrame, definitions: DataFrame, type_col: str, out: str) -> DataFrame:
    """Add a (name, definition) struct for uses[type_col]; the definition is null when unknown.

    `definitions` is unique per name, so a type name that everyone uses is a one-sided skew
    that the adaptive skew join splits.
    """
    shown = F.col(type_col)
    base = F.when(~shown.startswith("self_field:"), base_type_name(shown))
    joined = uses.withColumn("base_name", base).join(definitions, ["project_id", "base_name"], "left")
    ref = F.when(shown.isNotNull(), F.struct(shown.alias("name"), F.col("definition")))
    return joined.withColumn(out, ref).drop("base_name", "definition")


def param_rows(symbols: DataFrame) -> DataFrame:
    """One row per parameter; needs params, symbol_uid and the owner's parent_node_id."""
    return symbols.select(
        "project_id", "symbol_uid", "node_id", "parent_node_id", "kind", F.explode("params").alias("p"),
    ).select("project_id", "symbol_uid", "node_id", "parent_node_id", "kind", "p.*")


def resolve_own_fields(params: DataFrame, symbols: DataFrame) -> DataFrame:
    """Replace `self_field:x` types of constructor parameters by the type of the sibling field x."""
    fields = (
        symbols.filter(sig.is_field(F.col("kind")) & F.col("parent_node_id").isNotNull())
        .groupBy("project_id", "parent_node_id", F.col("name").alias("field"))
        .agg(F.min_by("resolved_type", "ord").alias("field_type"))
    )
    own = F.col("type").startswith("self_field:") & (F.col("kind") == KIND_CONSTRUCTOR)
    wanted = (
        params.filter(own).withColumn("field", F.expr("substring(type, length('self_field:') + 1)"))
        .join(fields, ["project_id", "parent_node_id", "field"], "left")
        .withColumn("type", F.coalesce("field_type", "type")).drop("field", "field_type")
    )
    return wanted.unionByName(params.filter(~own))
