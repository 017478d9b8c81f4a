"""Action templates: a constant table of a few dozen rows."""

from __future__ import annotations

import ast
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewops.fixed_values import ACTION_TEMPLATES, COST_CONSTANTS, TIMEFRAMES

SCHEMA = ("cause string, timeframe string, action string, cost_formula string, timeline string, expected_impact string, "
          "timeframe_order int, action_order int")

_NAMES = "|".join(["rooms", *COST_CONSTANTS])
_ALLOWED = re.compile(rf"(?:{_NAMES}|[\d.+\-*/()\s])+")
_SIMPLE_DIVISOR = re.compile(rf"/\s*({_NAMES}|[\d.]+)")


def cost_formula(formula: str | None, rooms: str = "rooms") -> Column:
    """Cost of a formula over the column ``rooms`` and the cost constants.

    Only numbers, + - * / and parentheses, ``rooms`` and the constants are let
    through; anything else raises ValueError. Blank formulas, formulas that are not
    valid arithmetic and divisions by zero cost 0.
    """
    if not formula or not formula.strip():
        return F.lit(0.0)
    if not _ALLOWED.fullmatch(formula) or "**" in formula or "//" in formula:
        raise ValueError(f"cost formula may only use numbers, + - * / ( ) and {_NAMES}: {formula!r}")
    try:
        ast.parse(formula.strip(), mode="eval")
    except SyntaxError:
        return F.lit(0.0)
    sql = _SIMPLE_DIVISOR.sub(r"/ nullif(\1, 0)", formula)
    for name, value in COST_CONSTANTS.items():
        sql = sql.replace(name, str(value))
    return F.coalesce(F.expr(sql.replace("rooms", f"`{rooms}`")).cast("double"), F.lit(0.0))


def cost_by_formula(formulas: list[str], column: str = "cost_formula", rooms: str = "rooms") -> Column:
    """Cost of the formula named in each row. The formulas are known when the plan is made."""
    out = F
    for formula in sorted(set(formulas)):
        out = out.when(F.col(column) == formula, cost_formula(formula, rooms))
    return out.otherwise(F.lit(0.0))


def template_rows(path: str | None = None) -> list[tuple[str, str, str, str, str, str]]:
    """The built-in templates, or those of a JSON file: cause -> timeframe -> list of actions."""
    if path is None:
        return ACTION_TEMPLATES
    with open(path, encoding="utf-8") as file:
        causes = json.load(file)
    return [(cause, frame, a.get("action", ""), a.get("cost_formula", "0"), a.get("timeline", ""), a.get("impact", ""))
            for cause, frames in causes.items() for frame in TIMEFRAMES for a in frames.get(frame, [])]


def action_templates(spark: SparkSession, rows=None) -> DataFrame:
    """Templates in order, with their positions."""
    rows = rows if rows is not None else ACTION_TEMPLATES
    return spark.createDataFrame([(*r, TIMEFRAMES.index(r[1]), i) for i, r in enumerate(rows)], SCHEMA)
