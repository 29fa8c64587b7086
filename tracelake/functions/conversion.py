"""Conversion rules compiled to Column expressions.

Every rule is element-wise, so it becomes one Catalyst expression: filters, joins and aggregations over converted values
stay in whole-stage code generation.  Small tables are CASE chains; beyond ``CHAIN`` entries the keys are an array
literal and a lookup costs two short scans (of every n-th key, then of one stretch), which keeps generated methods small.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.formula import compile_formula, ieee_divide
from tracelake.sources.blocks import Conversion

CHAIN = 64
NONE, LINEAR, RATIONAL, ALGEBRAIC, VALUE_LINEAR, VALUE_NEAREST, RANGE_VALUE, VALUE_TEXT, RANGE_TEXT, TEXT_VALUE, TEXT_TEXT, BITFIELD = range(12)


class ConversionError(ValueError):
    """A rule that is unknown, incomplete or of the wrong kind for its channel."""


@dataclass
class Typed:
    """A Column and what it yields: number, text, mixed (struct of num and text) or raw."""

    column: Column
    kind: str


def _need(ok: bool, cc: Conversion) -> None:
    if not ok:
        raise ConversionError(f"a conversion of type {cc.kind} with {len(cc.values)} values and {len(cc.refs)} references")


def linear(x: Column, p1: float, p2: float) -> Column:
    """x * p2 + p1."""
    return x * F.lit(float(p2)) + F.lit(float(p1))


def rational(x: Column, p: list[float]) -> Column:
    """(p1 x^2 + p2 x + p3) / (p4 x^2 + p5 x + p6), with IEEE division."""
    a, b, c, d, e, f = (F.lit(float(v)) for v in p)
    return ieee_divide(a * x * x + b * x + c, d * x * x + e * x + f)


def count_until(keys: list[float], x: Column, inclusive: bool) -> Column:
    """How many of the sorted ``keys`` are <= x (``inclusive``) or < x; NaN keys are not allowed, a NaN x is after all."""
    stride = max(1, math.isqrt(len(keys)))
    coarse = F.array(*[F.lit(float(k)) for k in keys[stride - 1 :: stride]])
    fine = F.array(*[F.lit(float(k)) for k in keys])
    test = (lambda k: k <= x) if inclusive else (lambda k: k < x)
    whole = F.size(F.filter(coarse, test)) * stride
    return whole + F.size(F.filter(F.slice(fine, whole + 1, F.lit(stride)), test))


def value_linear(x: Column, keys: list[float], values: list[float]) -> Column:
    """Interpolated between pairs, the end values outside; NaN stays NaN."""
    n = len(keys)
    if n <= CHAIN:
        out = F.when(F.isnan(x), x).when(x <= keys[0], F.lit(values[0])).when(x >= keys[-1], F.lit(values[-1]))
        for i in range(n - 1):
            if keys[i + 1] > keys[i]:
                out = out.when(x < keys[i + 1], F.lit(values[i]) + ((x - keys[i]) * F.lit(values[i + 1] - values[i])) / F.lit(keys[i + 1] - keys[i]))
        return out.otherwise(F.lit(values[-1]))
    ks, vs = (F.array(*map(F.lit, a)) for a in (keys, values))
    i = count_until(keys, x, True) - 1
    x0, x1, y0, y1 = F.get(ks, i), F.get(ks, i + 1), F.get(vs, i), F.get(vs, i + 1)
    return F.when(F.isnan(x), x).when(x <= keys[0], F.lit(values[0])).when(x >= keys[-1], F.lit(values[-1])).otherwise(y0 + ((x - x0) * (y1 - y0)) / (x1 - x0))


def value_nearest(x: Column, keys: list[float], values: list[float]) -> Column:
    """The value of the nearest key; a tie goes to the lower one, NaN to the last."""
    n = len(keys)
    if n <= CHAIN:
        out = F.when(F.isnan(x), F.lit(values[-1])).when(x <= keys[0], F.lit(values[0]))
        for i in range(1, n):
            out = out.when(x <= keys[i], F.when(x - keys[i - 1] > keys[i] - x, F.lit(values[i])).otherwise(F.lit(values[i - 1])))
        return out.otherwise(F.lit(values[-1]))
    ks, vs = (F.array(*map(F.lit, a)) for a in (keys, values))
    i = count_until(keys, x, False)
    upper = x - F.get(ks, i - 1) > F.get(ks, i) - x
    return F.when(F.isnan(x) | (x > keys[-1]), F.lit(values[-1])).when(x <= keys[0], F.lit(values[0])).otherwise(F.when(upper, F.get(vs, i)).otherwise(F.get(vs, i - 1)))


def range_pick(x: Column, ranges: list[tuple[float, float]], outs: list[Column], default: Column, inclusive: bool) -> Column:
    """The output of the first range whose maximum is not below x, if x is not below its minimum; NaN and misses: default.

    ``inclusive`` (integer channels): min <= x <= max; else min <= x < max.
    """
    miss = F.isnan(x)
    if len(ranges) <= CHAIN:
        out = F.when(miss, default)
        for (lo, hi), value in zip(ranges, outs, strict=True):
            out = out.when(x <= hi if inclusive else x < hi, F.when(x >= lo, value).otherwise(default))
        return out.otherwise(default)
    highs = [hi for _, hi in ranges]
    i = count_until(highs, x, not inclusive)
    lows, values = F.array(*[F.lit(lo) for lo, _ in ranges]), F.array(*outs)
    hit = ~miss & (i < len(ranges)) & (x >= F.get(lows, i))
    return F.when(hit, F.get(values, i)).otherwise(default)


def value_pick(x: Column, keys: list[float], outs: list[Column], default: Column) -> Column:
    """The output of the key equal to x (the first of equal keys), else default."""
    if len(keys) <= CHAIN:
        out = F.when(F.isnan(x), default)
        for k, value in zip(keys, outs, strict=True):
            out = out.when(x == k, value)
        return out.otherwise(default)
    i = F.array_position(F.array(*map(F.lit, keys)), x).cast("int")
    return F.when(~F.isnan(x) & (i > 0), F.get(F.array(*outs), i - 1)).otherwise(default)


def text_pick(s: Column, keys: list[str | None], outs: list[Column], default: Column) -> Column:
    """The output of the key equal to the text (the last of equal keys), else default; null stays null."""
    table = {k: v for k, v in zip(keys, outs, strict=True) if k is not None}
    if len(table) <= CHAIN:
        out = F.when(s.isNull(), F.lit(None))
        for k, value in table.items():
            out = out.when(s == k, value)
        return out.otherwise(default)
    i = F.array_position(F.array(*map(F.lit, table)), s).cast("int")
    return F.when(s.isNull(), F.lit(None)).when(i > 0, F.get(F.array(*table.values()), i - 1)).otherwise(default)


def _outputs(x: Column, refs: list) -> tuple[list[Column], str]:
    """Columns of the references, all of one kind: texts, or structs if any is a rule (then on half-open ranges)."""
    if not any(isinstance(r, Conversion) for r in refs):
        return [F.lit(r).cast("string") for r in refs], "text"
    out = []
    for r in refs:
        if not isinstance(r, Conversion):
            num, text = F.lit(None).cast("double"), F.lit(r).cast("string")
        else:
            inner = compile_conversion(r, x, integer=False)
            if inner.kind == "mixed":
                num, text = inner.column["num"], inner.column["text"]
            elif inner.kind == "text":
                num, text = F.lit(None).cast("double"), inner.column
            else:
                num, text = inner.column.cast("double"), F.lit(None).cast("string")
        out.append(F.struct(num.alias("num"), text.alias("text")))
    return out, "mixed"


def bitfield(x: Column, cc: Conversion) -> Column:
    """Texts of all parts, joined by ``|``: each part is a rule applied to the masked bits."""
    parts = []
    for mask, r in zip(cc.masks, cc.refs, strict=False):
        if isinstance(r, Conversion):
            inner = compile_conversion(r, x.cast("long").bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64))), integer=True)
            text = inner.column["text"] if inner.kind == "mixed" else inner.column.cast("string")
            parts.append(F.when(text.isNotNull(), F.concat(F.lit(f"{r.name} = "), text)) if r.name else text)
        elif r is not None:
            parts.append(F.when(x.cast("long").bitwiseAND(F.lit(mask)) != 0, F.lit(r)))
    return F.concat_ws("|", *parts)


def compile_conversion(cc: Conversion | None, raw: Column, *, integer: bool = False, textual: bool = False, bits: str = "identity") -> Typed:
    """The rule's Column for a raw Column; ``integer`` channels have closed ranges, ``textual`` ones hold strings.

    Null stays null in every rule but the bitfield's text.  ``bits`` is ``identity`` (a bitfield rule leaves samples as
    they are) or ``text``.
    """
    if cc is None or cc.kind == NONE:
        return Typed(raw, "raw")
    wants_text = cc.kind in (TEXT_VALUE, TEXT_TEXT)
    if cc.kind == BITFIELD:
        return Typed(bitfield(raw, cc), "text") if bits == "text" else Typed(raw, "raw")
    if not NONE <= cc.kind <= BITFIELD:
        raise ConversionError(f"conversion type {cc.kind} is unknown")
    if wants_text != textual:
        raise ConversionError(f"a conversion of type {cc.kind} cannot be applied to {'text' if textual else 'numbers'}")
    v, refs = [float(y) for y in cc.values], cc.refs
    if wants_text:
        if cc.kind == TEXT_VALUE:
            _need(len(v) == len(refs) + 1, cc)
            return Typed(text_pick(raw, refs, [F.lit(float(y)) for y in v[:-1]], F.lit(float(v[-1]))), "number")
        _need(len(refs) % 2 == 1, cc)
        return Typed(text_pick(raw, refs[0:-1:2], [F.lit(r).cast("string") for r in refs[1::2]], F.lit(refs[-1]).cast("string")), "text")
    x = raw.cast("double")

    def guarded(c: Column) -> Column:
        return F.when(x.isNotNull(), c)

    if cc.kind == LINEAR:
        _need(len(v) >= 2, cc)
        return Typed(linear(x, v[0], v[1]), "number")
    if cc.kind == RATIONAL:
        _need(len(v) >= 6, cc)
        return Typed(guarded(rational(x, v[:6])), "number")
    if cc.kind == ALGEBRAIC:
        _need(bool(refs) and isinstance(refs[0], str), cc)
        return Typed(guarded(compile_formula(refs[0], x)), "number")
    if cc.kind in (VALUE_LINEAR, VALUE_NEAREST):
        _need(len(v) >= 2 and len(v) % 2 == 0, cc)
        return Typed(guarded((value_linear if cc.kind == VALUE_LINEAR else value_nearest)(x, v[0::2], v[1::2])), "number")
    if cc.kind == RANGE_VALUE:
        _need(len(v) % 3 == 1, cc)
        return Typed(guarded(range_pick(x, list(zip(v[0:-1:3], v[1::3], strict=False)), [F.lit(y) for y in v[2::3]], F.lit(v[-1]), integer)), "number")
    if cc.kind == VALUE_TEXT:
        _need(len(refs) == len(v) + 1, cc)
        outs, kind = _outputs(x, refs)
        return Typed(guarded(value_pick(x, v, outs[:-1], outs[-1])), kind)
    _need(len(v) == 2 * (len(refs) - 1), cc)
    outs, kind = _outputs(x, refs)
    return Typed(guarded(range_pick(x, list(zip(v[0::2], v[1::2], strict=True)), outs[:-1], outs[-1], integer)), kind)
