"""The registry of factors: named columns over a panel, by category."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.panel import Panel

CATEGORIES = ("reversal_momentum", "volatility", "liquidity", "volume_price", "technical", "price_structure", "value", "quality", "growth", "composite", "external")


@dataclass(frozen=True)
class Factor:
    name: str
    category: str
    requires: tuple[str, ...]
    build: Callable[[Panel], Column]
    note: str = ""


_factors: dict[str, Factor] = {}
#: What modules of factors do before any is computed.
BEFORE: list[Callable[[], None]] = []


def register(name: str, category: str, requires: tuple[str, ...] | list[str], build: Callable[[Panel], Column], note: str = "") -> Factor:
    if name in _factors:
        raise ValueError(f"factor {name} is registered")
    if category not in CATEGORIES:
        raise ValueError(f"unknown category {category}")
    _factors[name] = Factor(name, category, tuple(requires), build, note)
    return _factors[name]


def factor(name: str, category: str, requires=(), note: str = ""):
    """Decorator form of ``register``."""

    def wrap(f):
        register(name, category, requires, f, note)
        return f

    return wrap


def get(name: str) -> Factor:
    return _factors[name]


def names(category: str | None = None) -> list[str]:
    return [f.name for f in _factors.values() if category in (None, f.category)]


def summary() -> dict[str, int]:
    return {c: n for c in CATEGORIES if (n := len(names(c)))}


def compute(p: Panel, wanted: list[str], strict: bool = False) -> DataFrame:
    """The panel's key and the wanted factors, in one plan.

    A factor whose inputs are missing is a column of nulls, or an error if ``strict``.
    """
    for f in BEFORE:
        f()
    have, cols = set(p.df.columns), {}
    for name in wanted:
        f = get(name)
        missing = [c for c in f.requires if c not in have]
        if missing and strict:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        cols[name] = p.let(F.lit(None).cast("double") if missing else f.build(p).cast("double"))
    return p.select(**cols)
