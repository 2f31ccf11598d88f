"""The registered queries and their SQL counterparts over the given tables."""

from sluice.queries import gate_queries, identity_queries, profile_queries, run_queries, source_queries, store_queries

FAMILIES = (profile_queries, identity_queries, gate_queries, run_queries, source_queries, store_queries)


def all_queries():
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def all_oracles():
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
