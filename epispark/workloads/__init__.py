"""The registered queries, each with its SQL counterpart where SQL can say it."""

from epispark.workloads import calls, genome, graph, learning, nodes

MODULES = (calls, genome, graph, nodes, learning)


def queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
