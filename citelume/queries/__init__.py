"""The driver's queries over the engine's own operators, and their SQL."""

from . import cataloguing, ingesting, labelling, retrieving, texts

MODULES = (texts, labelling, ingesting, retrieving, cataloguing)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: s for m in MODULES for name, s in m.SQL.items()}
