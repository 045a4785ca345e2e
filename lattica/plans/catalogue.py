"""All registered graph queries and the SQL that they must agree with."""

from __future__ import annotations

from lattica.plans import advanced, aggregates, chains, corpus, corpus_more, domains, etl, etl_more, etl_sources, graph_queries, lookups, pipelines, predictions, rules, search, shapes, source_reports, vectors
from lattica.plans.registry import QUERIES, SQL

MODULES = (advanced, aggregates, domains, rules, search, graph_queries, etl, etl_more, etl_sources, vectors, corpus, corpus_more, predictions, shapes, chains, source_reports, pipelines, lookups)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
