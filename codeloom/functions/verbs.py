"""Verbs, categories and sentence templates of a relation, all as message keys."""

from itertools import chain

from pyspark.sql import Column, functions as F

# --- fixed values --------------------------------------------------------------------
# normalised edge label -> verb key when no rule applies
DEFAULT_VERBS = {
    "extends": "verb.extends",
    "implements": "verb.implements",
    "calls": "verb.calls",
    "reads-from": "verb.readsFrom",
    "writes-to": "verb.writesTo",
    "instance-of": "verb.instanceOf",
    "uses-as-type": "verb.usesAsType",
    "unknown": "verb.unknown",
}
# (label, source layer, target layer, part of the target name, verb key); None matches anything
SMART_VERBS = [
    (None, "view", "state", None, "verb.reactsTo"),
    ("calls", "view", "state", None, "verb.notifies"),
    ("instance-of", "view", "view", None, "verb.buildsAndShows"),
    ("calls", "state", "service", None, "verb.delegates"),
    ("reads-from", "state", "model", None, "verb.managesState"),
    ("instance-of", "service", "model", None, "verb.assembles"),
    (None, "model", "model", None, "verb.composedOf"),
    ("calls", None, None, "analytics", "verb.reportsEvent"),
    ("calls", None, None, "dialog|snackbar|alert", "verb.showsUser"),
    ("calls", None, None, "formatter", "verb.formats"),
]
VERB_CATEGORIES = {
    "verb.showsUser": "ui", "verb.buildsAndShows": "ui",
    "verb.readsFrom": "data", "verb.managesState": "data",
    "verb.delegates": "logic", "verb.notifies": "logic",
    "verb.extends": "inheritance", "verb.implements": "inheritance",
    "verb.composedOf": "composition",
    "verb.formats": "formatting",
}
# verbs that have a sentence of their own, under narrative.<verb key>
NARRATED_VERBS = [
    "verb.showsUser", "verb.readsFrom", "verb.buildsAndShows", "verb.instanceOf", "verb.notifies",
    "verb.delegates", "verb.formats", "verb.managesState", "verb.reactsTo", "verb.implements", "verb.extends",
]


def _mapped(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain(*table.items())])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def label_class(label: Column) -> Column:
    return F.replace(F.lower(F.coalesce(label, F.lit("unknown"))), F.lit("_"), F.lit("-"))


def smart_verb(label: Column, source_layer: Column, target_layer: Column, target_label: Column) -> Column:
    """`label` is the normalised one. First matching rule wins, then the default verb."""
    name = F.lower(target_label)
    chosen = F
    for want_label, want_source, want_target, part, verb in SMART_VERBS:
        tests = []
        if want_label:
            tests.append(label == want_label)
        if want_source:
            tests += [source_layer == want_source, target_layer == want_target]
        if part:
            tests.append(name.rlike(part))
        cond = tests[0]
        for t in tests[1:]:
            cond = cond & t
        chosen = chosen.when(cond, F.lit(verb))
    return chosen.otherwise(_mapped(DEFAULT_VERBS, label, "verb.unknown"))


def verb_category(verb: Column) -> Column:
    return _mapped(VERB_CATEGORIES, verb, "other")


def narrative_key(verb: Column) -> Column:
    return F.when(verb.isin(NARRATED_VERBS), F.concat(F.lit("narrative."), verb)).otherwise("narrative.default")
