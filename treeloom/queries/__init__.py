"""The engine's registered queries with their SQL counterparts."""

from __future__ import annotations

from . import conversion, details, found, grammars, streams, suites, trees, typed, values


def queries():
    return trees.QUERIES | conversion.QUERIES | values.QUERIES | grammars.QUERIES | typed.QUERIES | streams.QUERIES | suites.QUERIES | found.QUERIES | details.QUERIES


def oracle_sql():
    return trees.ORACLES | conversion.ORACLES | values.ORACLES | grammars.ORACLES | typed.ORACLES | streams.ORACLES | suites.ORACLES | found.ORACLES | details.ORACLES
