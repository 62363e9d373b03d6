"""Arithmetic formulas as text, compiled to columns or evaluated; nothing is ever passed to ``eval`` or ``expr``.

Grammar: sums of products of signed factors; a factor is a number, a name or a formula in parentheses. Names are whole
words, so ``x`` is not found inside ``max``.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|([-+*/()]))")


def parse(text: str):
    """A nested tuple: ("num", x), ("name", n), ("neg", a) or (operator, a, b). Raises ValueError for anything else."""
    toks, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not part of a formula: {text[at:]!r}")
        toks.append(("num", float(m[1])) if m[1] else ("name", m[2]) if m[2] else ("op", m[3]))
        at = m.end()
    toks.append(("end", ""))
    pos = 0

    def take(*ops):
        nonlocal pos
        if toks[pos][0] == "op" and toks[pos][1] in ops:
            pos += 1
            return toks[pos - 1][1]
        return None

    def sum_():
        out = product()
        while op := take("+", "-"):
            out = (op, out, product())
        return out

    def product():
        out = factor()
        while op := take("*", "/"):
            out = (op, out, factor())
        return out

    def factor():
        nonlocal pos
        if take("-"):
            return ("neg", factor())
        if take("+"):
            return factor()
        if take("("):
            out = sum_()
            if not take(")"):
                raise ValueError("a parenthesis is not closed")
            return out
        kind, value = toks[pos]
        if kind not in ("num", "name"):
            raise ValueError(f"a number or name is missing before {value!r}")
        pos += 1
        return (kind, value)

    out = sum_()
    if toks[pos][0] != "end":
        raise ValueError(f"left over: {toks[pos][1]!r}")
    return out


def column(text: str, names: dict):
    """The formula as a column; ``names`` maps its names to columns. A division by zero gives null."""

    def build(t):
        if t[0] == "num":
            return F.lit(t[1])
        if t[0] == "name":
            if t[1] not in names:
                raise ValueError(f"unknown name {t[1]!r}")
            return names[t[1]]
        if t[0] == "neg":
            return -build(t[1])
        a, b = build(t[1]), build(t[2])
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[t[0]]()

    return build(parse(text))


def clamped(value, low=None, high=None):
    value = value if low is None else F.greatest(value, F.lit(float(low)))
    return value if high is None else F.least(value, F.lit(float(high)))


def evaluate(text: str, values: dict, low=None, high=None):
    """The formula's number; None for a division by zero."""

    def go(t):
        if t[0] == "num":
            return t[1]
        if t[0] == "name":
            if t[1] not in values:
                raise ValueError(f"unknown name {t[1]!r}")
            return float(values[t[1]])
        if t[0] == "neg":
            a = go(t[1])
            return None if a is None else -a
        a, b = go(t[1]), go(t[2])
        if a is None or b is None or (t[0] == "/" and b == 0):
            return None
        return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else 0}[t[0]]

    x = go(parse(text))
    if x is not None:
        x = max(x, low) if low is not None else x
        x = min(x, high) if high is not None else x
    return x
