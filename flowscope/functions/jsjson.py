"""JSON text the way a browser writes it: compact, keys in their order, 1.0 as 1, nulls kept."""

from __future__ import annotations

import hashlib
import json
import math


def number(x: float) -> str:
    if isinstance(x, int) and abs(x) < 2**53:
        return str(x)
    x = float(x)
    if math.isnan(x) or math.isinf(x):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exponent = repr(x).partition("e")
    if not exponent:
        return digits
    e = int(exponent)
    if -7 < e < 0:
        sign, body = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
        return f"{sign}0.{'0' * (-e - 1)}{body.replace('.', '')}"
    return f"{digits.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"


def stringify(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{stringify(str(k))}:{stringify(x)}" for k, x in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(stringify, value)) + "]"
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    if isinstance(value, (int, float)):
        return number(value)
    return json.dumps(value, ensure_ascii=False)


class _Odd(Exception):
    """A number that Python's own writer would not write as a browser does."""


def _plain_int(text: str) -> int:
    if len(text) > 15:
        raise _Odd
    return int(text)


def _plain_float(text: str):
    x = float(text)
    if not abs(x) < 1e21:
        raise _Odd
    if x == int(x):
        return int(x)
    if "e" in repr(x):
        raise _Odd
    return x


def _no_number(text: str):
    raise _Odd


def _written(value) -> str:
    return json.dumps(value, ensure_ascii=False, check_circular=False, separators=(",", ":"))


def read(text: str):
    """(value, writer): a JSON text's value, and what writes it or a part of it as ``stringify`` does.

    Where all numbers look the same in Python and a browser, Python's writer in C does, many times as fast. Whole numbers
    come as int.
    """
    try:
        return json.loads(text, parse_int=_plain_int, parse_float=_plain_float, parse_constant=_no_number), _written
    except _Odd:
        return json.loads(text), stringify


def checksum(value, write=stringify) -> str:
    return hashlib.sha256(write(value).encode()).hexdigest()
