"""Query registry: name -> (Spark callable, DuckDB oracle SQL or None).

Each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables.  Oracle SQL runs on DuckDB with the base tables
registered as views; derived relations are spelled as CTEs from
``fixtures.SQL``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from runledger.plans.fixtures import SQL


@dataclass(frozen=True)
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, oracle)
        return fn

    return deco


def with_ctes(
    body: str,
    *names: str,
    recursive: bool = False,
    extra: dict[str, str] | None = None,
    raw: tuple[str, ...] = (),
) -> str:
    """Prefix ``body`` with the CTEs of the named derived relations.

    ``extra`` maps more CTE names to bodies; ``raw`` items are complete
    ``name as (...)`` definitions (several, comma separated, allowed).
    """
    parts = [f"{n} as ({SQL[n]})" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} as ({v})")
    parts += [r.strip() for r in raw]
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(parts) + "\n" + body


def load_all() -> dict[str, Entry]:
    # Importing the query modules fills REGISTRY.
    from runledger.plans import queries  # noqa: F401

    return REGISTRY
