"""Queries over the fixture tables, side by side with the SQL they are held against."""

from tracefolio.bindings import documents, evaluation, evidence, facts, registry, retrieval, state

MODULES = (facts, retrieval, evaluation, evidence, registry, state, documents)
