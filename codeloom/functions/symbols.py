"""Column builders for identity and simple properties of symbols."""

from itertools import chain

from pyspark.sql import Column, functions as F

from codeloom.schemas import (
    EXCLUDED_METHOD_NAMES, KIND_CLASS, KIND_CONSTRUCTOR, KIND_ENUM, KIND_FUNCTION, KIND_METHOD,
    KIND_NAMES, KIND_PREFIXES,
)


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def kind_name(kind: Column) -> Column:
    return F.coalesce(_lookup(KIND_NAMES, kind), F.concat(F.lit("kind_"), kind.cast("string")))


def kind_prefix(kind: Column) -> Column:
    return F.coalesce(_lookup(KIND_PREFIXES, kind), F.concat(F.lit("k"), kind.cast("string")))


def _uri_or_default(uri: Column) -> Column:
    return F.when(uri != "", uri).otherwise(F.lit("unknown_uri"))


def node_id(uri: Column, name: Column, kind: Column, parent_name: Column) -> Column:
    has_parent = F.coalesce(parent_name != "", F.lit(False))
    shown = F.when((kind == KIND_CONSTRUCTOR) & (name == parent_name), F.lit("_default_")).otherwise(name)
    return F.concat(
        _uri_or_default(uri),
        F.when(has_parent, F.concat(F.lit("#parent:"), parent_name)).otherwise(F.lit("")),
        F.lit("#kind:"), kind_prefix(kind), F.lit("#name:"), shown,
    )


def symbol_uid(uri: Column, name: Column, kind: Column) -> Column:
    return F.concat_ws("#", uri, name, kind.cast("string"))


def id_tail(whole: Column, uri: Column) -> Column:
    """An id without the uri of its file, which is short to move beside the uri; `id_whole` puts it back, whatever the id."""
    return F.when(whole.startswith(uri), F.concat(F.lit("+"), whole.substr(F.length(uri) + 1, F.length(whole)))).otherwise(
        F.concat(F.lit("="), whole))


def id_whole(tail: Column, uri: Column) -> Column:
    rest = tail.substr(F.lit(2), F.length(tail))
    return F.when(tail.startswith("+"), F.concat(uri, rest)).otherwise(rest)


def access(name: Column) -> Column:
    return F.when(name.startswith("_"), F.lit("private")).otherwise(F.lit("public"))


def is_sdk_uri(uri: Column) -> Column:
    return F.coalesce(uri.contains("/dart-sdk/lib/"), F.lit(False))


def is_relevant(name: Column, kind: Column) -> Column:
    """Public type, or public callable that carries none of the excluded names."""
    excluded = name.rlike("|".join(EXCLUDED_METHOD_NAMES))
    public = ~name.startswith("_")
    return public & (
        kind.isin(KIND_CLASS, KIND_ENUM) | (kind.isin(KIND_FUNCTION, KIND_METHOD) & ~excluded)
    )


def is_relevant_top_level(name: Column, kind: Column) -> Column:
    return kind.isin(KIND_CLASS, KIND_ENUM, KIND_FUNCTION) & ~name.startswith("_") & (F.length(name) > 2)


def is_executable(kind: Column) -> Column:
    return kind.isin(KIND_METHOD, KIND_FUNCTION, KIND_CONSTRUCTOR)


def is_relevant_package(name: Column, ptype: Column) -> Column:
    return ptype.isin("third_party", "custom") | (
        (ptype == "flutter_official") & ~name.isin("flutter", "flutter_test")
    )
