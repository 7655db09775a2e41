"""Named queries and their reference SQL."""
from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}  # name -> (statement, names of the expressions it uses)

#: Named common table expressions of the reference SQL: name -> (needs, body).
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def with_ctes(sql: str, *names: str) -> str:
    """Put the named expressions, and what they need, in front of a statement."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in CTES[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    return sql if not order else "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + sql


def query(name: str, sql: str | None = None, *ctes: str):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = (sql, ctes)
        return fn
    return register


def oracle(name: str) -> str:
    sql, ctes = ORACLES[name]
    return with_ctes(sql, *ctes)
