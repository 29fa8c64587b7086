"""Formulas of algebraic conversions, compiled to Column expressions (never evaluated as Python)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(\*\*|[-+*/^()]))")
#: Functions of one argument that a formula may call.
FUNCTIONS = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "exp": F.exp, "log": F.ln, "ln": F.ln, "log10": F.log10, "sqrt": F.sqrt, "abs": F.abs}


class FormulaError(ValueError):
    """A formula with something that is not in the grammar."""


def ieee_divide(num: Column, den: Column) -> Column:
    """num / den with infinities and NaN for a zero denominator, where Spark raises an error."""
    zero = den == 0
    negative = den.cast("string").startswith("-")  # -0.0
    endless = F.when(F.isnan(num) | (num == 0), F.lit(float("nan"))).when((num > 0) != negative, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(zero, endless).otherwise(num / F.when(zero, F.lit(1.0)).otherwise(den))


def compile_formula(formula: str, x: Column) -> Column:
    """The formula's Column for its variable ``X``: + - * / ^ ( ), numbers and ``FUNCTIONS``; ^ binds to the right."""
    tokens: list[tuple[str, str]] = []
    pos, text = 0, formula.strip()
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise FormulaError(f"{text[pos:]!r} in {formula!r}")
        tokens.append(("number", m[1]) if m[1] else ("name", m[2]) if m[2] else ("op", "^" if m[3] == "**" else m[3]))
        pos = m.end()
    at = 0

    def peek() -> str | None:
        return tokens[at][1] if at < len(tokens) and tokens[at][0] == "op" else None

    def take() -> tuple[str, str]:
        nonlocal at
        if at >= len(tokens):
            raise FormulaError(f"{formula!r} ends too soon")
        at += 1
        return tokens[at - 1]

    def expect(op: str) -> None:
        if take() != ("op", op):
            raise FormulaError(f"{op!r} expected in {formula!r}")

    def total() -> Column:
        out = product()
        while peek() in ("+", "-"):
            out = out + product() if take()[1] == "+" else out - product()
        return out

    def product() -> Column:
        out = signed()
        while peek() in ("*", "/"):
            out = out * signed() if take()[1] == "*" else ieee_divide(out, signed())
        return out

    def signed() -> Column:
        if peek() in ("+", "-"):
            return -signed() if take()[1] == "-" else signed()
        return power()

    def power() -> Column:
        base = atom()
        if peek() == "^":
            take()
            return F.pow(base, signed())
        return base

    def atom() -> Column:
        kind, value = take()
        if kind == "number":
            return F.lit(float(value))
        if kind == "name":
            if value.upper() == "X":
                return x
            if value.lower() in FUNCTIONS:
                expect("(")
                inner = total()
                expect(")")
                return FUNCTIONS[value.lower()](inner)
            raise FormulaError(f"{value!r} in {formula!r}")
        if value == "(":
            inner = total()
            expect(")")
            return inner
        raise FormulaError(f"{value!r} in {formula!r}")

    out = total()
    if at != len(tokens):
        raise FormulaError(f"{tokens[at][1]!r} in {formula!r}")
    return out
