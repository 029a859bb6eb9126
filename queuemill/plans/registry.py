"""Named queries: a Spark callable and, where SQL can say the same, its check in SQL."""

from __future__ import annotations

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)` under `name`."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return add


def with_ctes(ctes: list[tuple[str, str]], body: str, once: bool = False) -> str:
    """`once`: parts that several others read are computed once and kept."""
    kept = "MATERIALIZED " if once else ""
    return "WITH " + ",\n".join(f"{name} AS {kept}({text})" for name, text in ctes) + "\n" + body
