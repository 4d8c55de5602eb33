"""The registry of queries over the engine's operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from vellum.plans import answers, coverage, generations, graded, inputs, records, scores, shapes, training

FLAGSHIP = "token_f1_pairs"
MODULES = (scores, training, answers, shapes, generations, inputs, records, coverage, graded)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
