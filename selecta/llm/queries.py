"""Registry of the package's queries: name -> (function, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def load() -> tuple[dict, dict]:
    """Import every query module and the pipeline; (queries, oracles)."""
    import importlib
    import pkgutil

    import selecta.llm as package
    for module in sorted(m.name for m in pkgutil.iter_modules(package.__path__)):
        if module.startswith("q_"):
            importlib.import_module(f"selecta.llm.{module}")
    importlib.import_module("corpus_pipeline")
    return QUERIES, ORACLES
