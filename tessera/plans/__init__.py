"""Registered queries and the SQL that each is checked against."""

from __future__ import annotations


def _load():
    from tessera.plans import audit, base, evaluation, factors, operators, pit, portfolio, statistics  # noqa: F401

    return base


def queries() -> dict:
    return _load().QUERIES


def oracles() -> dict[str, str]:
    return _load().SQL
