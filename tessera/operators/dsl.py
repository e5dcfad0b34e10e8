"""A small formula language: ``SAFE_DIV(TS_MEAN($close, 5), TS_STD($close, 20))``.

``$name`` is a column, numbers are literals, ``+ - * / **`` and single comparisons are
as in Python, and calls name the operators in ``OPERATORS``.  A formula is parsed,
checked against a whitelist and compiled to columns of a panel.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators import crosssection as cs
from tessera.operators import joins
from tessera.operators import timeseries as ts
from tessera.panel import Panel


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class Op:
    build: Callable
    columns: int
    numbers: tuple[int, int]  # least and most trailing literals
    whole: bool = True  # literals are whole numbers from 1


def _scalar(f):
    return lambda p, *a: f(*a)


OPERATORS: dict[str, Op] = {
    "DELAY": Op(ts.delay, 1, (0, 1)), "DELTA": Op(ts.delta, 1, (0, 1)), "TS_PCT_CHANGE": Op(ts.pct_change, 1, (1, 1)),
    "TS_MEAN": Op(ts.mean, 1, (1, 1)), "TS_SUM": Op(ts.total, 1, (1, 1)), "TS_STD": Op(ts.std, 1, (1, 1)),
    "TS_MEDIAN": Op(ts.median, 1, (1, 1)), "TS_QUANTILE": Op(ts.quantile, 1, (2, 2), False), "TS_MIN": Op(ts.low, 1, (1, 1)),
    "TS_MAX": Op(ts.high, 1, (1, 1)), "TS_SKEW": Op(ts.skew, 1, (1, 1)), "TS_KURT": Op(ts.kurt, 1, (1, 1)),
    "TS_POSITION": Op(ts.position, 1, (1, 1)), "TS_RANK_PCT": Op(ts.rank_pct, 1, (1, 1)), "TS_CORR": Op(ts.corr, 2, (1, 1)),
    "TS_COV": Op(ts.cov, 2, (1, 1)), "TS_MAD": Op(ts.mad, 1, (1, 1)), "EWM_MEAN": Op(ts.ewm_mean, 1, (1, 1)),
    "TS_COUNT": Op(ts.count, 1, (1, 1)), "TS_CONSECUTIVE_COUNT": Op(ts.consecutive_count, 1, (1, 1)),
    "TS_RSQUARE": Op(ts.rsquare, 2, (1, 1)), "TS_SLOPE": Op(ts.slope, 1, (1, 1)), "TS_DECAY_LINEAR": Op(ts.decay_linear, 1, (1, 1)),
    "SAFE_DIV": Op(_scalar(ts.safe_div), 2, (0, 0)), "CLIP": Op(_scalar(ts.clip), 1, (2, 2), False), "ABS": Op(_scalar(F.abs), 1, (0, 0)),
    "SIGN": Op(_scalar(F.signum), 1, (0, 0)), "LOG1P": Op(_scalar(ts.log1p), 1, (0, 0)), "SQRT": Op(_scalar(ts.sqrt), 1, (0, 0)),
    "WHERE": Op(_scalar(ts.where), 3, (0, 0)), "FIN_LAG_REPORT": Op(joins.report_lag, 1, (0, 1)),
    "FIN_DELTA_REPORT": Op(joins.report_delta, 1, (0, 1)), "CS_RANK": Op(cs.rank, 1, (0, 0)), "CS_ZSCORE": Op(cs.zscore, 1, (0, 0)),
}
_FIELD = re.compile(r"\$([A-Za-z_][A-Za-z0-9_]*)")
_MATH = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Pow: F.pow}
_TEST = {
    ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b,
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b,
}
_PREFIX = "field__"


def parse(formula: str) -> ast.expr:
    try:
        return ast.parse(_FIELD.sub(rf"{_PREFIX}\1", formula), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"can't parse {formula!r}: {e.msg}") from None


def fields(formula: str) -> list[str]:
    return sorted(set(_FIELD.findall(formula)))


def _number(node: ast.expr) -> float | int | None:
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        v = _number(node.operand)
        return None if v is None else -v
    if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
        return node.value
    return None


def check(formula: str, allowed: set[str] | None = None, financial: set[str] | None = None) -> list[str]:
    """What is wrong with a formula; nothing if it is fine.

    ``allowed`` are the fields that it may use, ``financial`` those that the FIN_ operators take.
    """
    try:
        tree = parse(formula)
    except FormulaError as e:
        return [str(e)]
    out: list[str] = []

    def walk(n: ast.expr) -> None:
        if _number(n) is not None:
            return
        if isinstance(n, ast.Name):
            if not n.id.startswith(_PREFIX):
                out.append(f"unknown name {n.id}")
            elif allowed is not None and n.id[len(_PREFIX) :] not in allowed:
                out.append(f"unknown field {n.id[len(_PREFIX) :]}")
        elif isinstance(n, ast.BinOp) and type(n.op) in _MATH:
            walk(n.left)
            walk(n.right)
        elif isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub | ast.UAdd):
            walk(n.operand)
        elif isinstance(n, ast.Compare):
            if len(n.ops) != 1 or type(n.ops[0]) not in _TEST:
                out.append("only single comparisons are allowed")
            for x in (n.left, *n.comparators):
                walk(x)
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
            op = OPERATORS.get(n.func.id)
            if not op:
                out.append(f"unknown operator {n.func.id}")
                return
            extra = len(n.args) - op.columns
            if not op.numbers[0] <= extra <= op.numbers[1]:
                out.append(f"{n.func.id} doesn't take {len(n.args)} arguments")
                return
            for x in n.args[op.columns :]:
                v = _number(x)
                if v is None or op.whole and (not isinstance(v, int) or v < 1):
                    out.append(f"{n.func.id} needs a {'positive whole ' * op.whole}number")
            if n.func.id.startswith("FIN_") and financial is not None:
                for x in n.args[: op.columns]:
                    if not isinstance(x, ast.Name) or x.id[len(_PREFIX) :] not in financial:
                        out.append(f"{n.func.id} takes a reported field")
            for x in n.args[: op.columns]:
                walk(x)
        else:
            out.append(f"{type(n).__name__} isn't allowed")

    walk(tree)
    return out


def check_batch(candidates: list[dict], allowed: set[str] | None = None, financial: set[str] | None = None) -> list[str]:
    """Checks of a batch of 1 to 5 candidates with unique names and declared inputs."""
    out = [] if 1 <= len(candidates) <= 5 else ["a batch has 1 to 5 candidates"]
    names = [c.get("name") for c in candidates]
    out += [f"name {n} repeats" for n in sorted({str(n) for n in names if names.count(n) > 1})]
    for c in candidates:
        missing = {"name", "formula", "inputs", "availability"} - c.keys()
        if missing:
            out.append(f"{c.get('name')}: no {', '.join(sorted(missing))}")
            continue
        out += [f"{c['name']}: {x}" for x in check(c["formula"], allowed, financial)]
        if c["availability"] != "after_close":
            out.append(f"{c['name']}: availability is after_close")
        if sorted(set(c["inputs"])) != fields(c["formula"]):
            out.append(f"{c['name']}: inputs differ from the fields of the formula")
    return out


def compile_formula(p: Panel, formula: str) -> Column:
    """The formula as a column of the panel."""
    if wrong := check(formula, set(p.df.columns)):
        raise FormulaError("; ".join(wrong))

    def visit(n: ast.expr) -> Column:
        if (v := _number(n)) is not None:
            return F.lit(float(v))
        if isinstance(n, ast.Name):
            return F.col(n.id[len(_PREFIX) :]).try_cast("double")  # text that is no number is missing
        if isinstance(n, ast.BinOp):
            return _MATH[type(n.op)](visit(n.left), visit(n.right))
        if isinstance(n, ast.UnaryOp):
            return -visit(n.operand) if isinstance(n.op, ast.USub) else visit(n.operand)
        if isinstance(n, ast.Compare):
            # a comparison with a missing value is false (true for !=)
            return F.coalesce(_TEST[type(n.ops[0])](visit(n.left), visit(n.comparators[0])), F.lit(isinstance(n.ops[0], ast.NotEq)))
        op = OPERATORS[n.func.id]
        numbers = [_number(x) for x in n.args[op.columns :]]
        if n.func.id == "TS_QUANTILE":
            numbers[0] = int(numbers[0])
        return op.build(p, *[visit(x) for x in n.args[: op.columns]], *numbers)

    return p.let(visit(parse(formula)))
