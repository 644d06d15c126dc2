"""Registered queries: name -> (Spark query, SQL that gives the same rows or None)."""

from codeloom.queries import code, documents, files, graph, packages, signatures

MODULES = [graph, signatures, code, documents, files, packages]


def registry() -> dict:
    found = {}
    for module in MODULES:
        clash = found.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        found.update(module.QUERIES)
    return found
