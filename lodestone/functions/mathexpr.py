"""Formulas: a LaTeX subset as rational functions, their equality, solutions and linear script.

A formula is a quotient of two polynomials with exact coefficients; a polynomial maps a
product of powers to its coefficient. What isn't understood is unknown, never equal or unequal.
"""

from __future__ import annotations

import re
from fractions import Fraction
from math import isqrt

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

Poly = dict[tuple[tuple[str, int], ...], Fraction]
_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|\\([A-Za-z]+|[%!,;: ])|([A-Za-z])|(.))", re.S)
#: Commands that space or size and say nothing, and commands for signs.
SILENT = {"left", "right", "quad", ",", ";", ":", "!", " ", "displaystyle"}
SIGNS = {"cdot": "*", "times": "*", "div": "/", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "lt": "<", "gt": ">"}
PLAIN = {"×": "*", "÷": "/", "−": "-", "–": "-", "·": "*"}
RELATIONS = "=≤≥≠<>"


class Unknown(ValueError):
    """The formula has something that isn't in the subset."""


def tokens(s: str) -> list[str]:
    out = []
    for number, command, letter, sign in _TOKEN.findall(s.strip().strip("$").rstrip(".,;")):
        if number or letter:
            out.append(number or letter)
        elif command:
            if command not in SILENT:
                out.append(SIGNS.get(command, "\\" + command))
        elif sign.strip():
            out.append(PLAIN.get(sign, sign))
    return out


def _add(a: Poly, b: Poly, k: int = 1) -> Poly:
    out = dict(a)
    for m, c in b.items():
        out[m] = out.get(m, Fraction(0)) + k * c
    return {m: c for m, c in out.items() if c}


def _mul(a: Poly, b: Poly) -> Poly:
    out: Poly = {}
    for m, c in a.items():
        for n, d in b.items():
            powers = dict(m)
            for v, e in n:
                powers[v] = powers.get(v, 0) + e
            key = tuple(sorted(powers.items()))
            out[key] = out.get(key, Fraction(0)) + c * d
    return {m: c for m, c in out.items() if c}


ONE: Poly = {(): Fraction(1)}
Ratio = tuple[Poly, Poly]


class _Reader:
    """One pass over the tokens by precedence: sums, products (also without a sign), powers."""

    def __init__(self, toks: list[str]):
        self.t, self.i = toks, 0

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def take(self, want: str = "") -> str:
        got = self.peek()
        if not got or (want and got != want):
            raise Unknown(f"expected {want or 'more'}")
        self.i += 1
        return got

    def sum(self) -> Ratio:
        sign = -1 if self.peek() == "-" else 1
        if self.peek() in ("+", "-"):
            self.take()
        n, d = self.product()
        n = {m: sign * c for m, c in n.items()}
        while self.peek() in ("+", "-"):
            k = 1 if self.take() == "+" else -1
            a, b = self.product()
            n, d = _add(_mul(n, b), _mul(a, d), k), _mul(d, b)
        return n, d

    def product(self) -> Ratio:
        n, d = self.power()
        while True:
            p = self.peek()
            if p in ("*", "/"):
                self.take()
                a, b = self.power()
                n, d = (_mul(n, a), _mul(d, b)) if p == "*" else (_mul(n, b), _mul(d, a))
            elif p and (p[0].isalnum() or p in ("(", "{", "\\frac")):
                a, b = self.power()
                n, d = _mul(n, a), _mul(d, b)
            else:
                return n, d

    def power(self) -> Ratio:
        n, d = self.atom()
        if self.peek() == "^":
            self.take()
            e = self.group() if self.peek() == "{" else [self.take()]
            if len(e) != 1 or not e[0].isdigit() or int(e[0]) > 12:
                raise Unknown("power")
            a, b = ONE, ONE
            for _ in range(int(e[0])):
                a, b = _mul(a, n), _mul(b, d)
            return a, b
        return n, d

    def group(self) -> list[str]:
        self.take("{")
        depth, start = 1, self.i
        while depth:
            x = self.take()
            depth += (x == "{") - (x == "}")
        return self.t[start : self.i - 1]

    def atom(self) -> Ratio:
        x = self.take()
        if x[0].isdigit():
            return {(): Fraction(x)} if Fraction(x) else {}, ONE
        if len(x) == 1 and x.isalpha():
            return {((x, 1),): Fraction(1)}, ONE
        if x in ("(", "{"):
            out = self.sum()
            self.take(")" if x == "(" else "}")
            return out
        if x == "\\frac":
            a, b = read(self.group()), read(self.group())
            return _mul(a[0], b[1]), _mul(a[1], b[0])
        raise Unknown(x)


def read(toks: list[str]) -> Ratio:
    r = _Reader(toks)
    out = r.sum()
    if r.i != len(toks) or not out[1]:
        raise Unknown("rest")
    return out


def sides(s: str) -> tuple[str, list[Ratio]]:
    """The relation of a formula ('' for none) and its sides."""
    toks = tokens(s)
    at = [i for i, x in enumerate(toks) if x in RELATIONS]
    if len(at) > 1 or not toks:
        raise Unknown("relations")
    if not at:
        return "", [read(toks)]
    return toks[at[0]], [read(toks[: at[0]]), read(toks[at[0] + 1 :])]


def _same(a: Ratio, b: Ratio) -> bool:
    return not _add(_mul(a[0], b[1]), _mul(b[0], a[1]), -1)


def _difference(parts: list[Ratio]) -> Poly:
    (a, b), (c, d) = parts
    return _add(_mul(a, d), _mul(c, b), -1)


def compare(a: str | None, b: str | None) -> str:
    """MATCH, MISMATCH or UNKNOWN: expressions by value, equations up to a constant factor."""
    try:
        if not a or not b or not re.search(r"[0-9+\-*/^=<>\\]", a + b):
            return "UNKNOWN"
        (ra, pa), (rb, pb) = sides(a), sides(b)
    except (ValueError, ZeroDivisionError, RecursionError):  # ValueError: signs such as ² that are digits, but no numbers
        return "UNKNOWN"
    if bool(ra) != bool(rb):
        return "UNKNOWN"
    if not ra:
        return "MATCH" if _same(pa[0], pb[0]) else "MISMATCH"
    if ra != rb:
        return "UNKNOWN"
    x, y = _difference(pa), _difference(pb)
    if set(x) == set(y) and x:
        k = {x[m] / y[m] for m in x}
        if len(k) == 1 and (ra == "=" or k.pop() > 0):
            return "MATCH"
    return "MATCH" if x == y else "MISMATCH" if ra == "=" else "UNKNOWN"


def solve(s: str | None) -> list[Fraction] | None:
    """Rational solutions of an equation in one unknown of degree 1 or 2; None where there is no such equation."""
    try:
        rel, parts = sides(s or "")
        if rel != "=":
            return None
        p = _difference(parts)
    except (Unknown, ZeroDivisionError):
        return None
    names = {v for m in p for v, _ in m}
    if len(names) != 1 or any(sum(e for _, e in m) > 2 for m in p):
        return None
    c = [Fraction(0)] * 3
    for m, k in p.items():
        c[sum(e for _, e in m)] += k
    if not c[2]:
        return [-c[0] / c[1]]
    disc = c[1] * c[1] - 4 * c[2] * c[0]
    if disc < 0:
        return []
    n, d = isqrt(disc.numerator), isqrt(disc.denominator)
    if n * n != disc.numerator or d * d != disc.denominator:
        return None
    return sorted({(-c[1] + k * Fraction(n, d)) / (2 * c[2]) for k in (1, -1)})


def linear(s: str | None) -> str | None:
    """A formula as one line of script (``{1} over {2}``, ``sqrt {x}``); None for what isn't in the subset."""
    if not s or not s.strip():
        return None
    words = {"\\frac": "over", "\\sqrt": "sqrt", "\\overline": "bar", "\\angle": "angle", "\\circ": "deg", "\\text": "rm", "\\pi": "pi", "\\theta": "theta", "\\triangle": "tri"}
    t = tokens(s)

    def group(i: int) -> tuple[str, int]:
        if i >= len(t) or t[i] != "{":
            raise Unknown("group")
        depth, j = 1, i + 1
        while depth:
            if j >= len(t):
                raise Unknown("braces")
            depth += (t[j] == "{") - (t[j] == "}")
            j += 1
        return walk(t[i + 1 : j - 1]), j

    def walk(part: list[str]) -> str:
        nonlocal t
        keep, t = t, part
        done, k = [], 0
        try:
            while k < len(t):
                x = t[k]
                if x == "\\frac":
                    a, k = group(k + 1)
                    b, k = group(k)
                    done.append(f"{{{a}}} over {{{b}}}")
                elif x == "{":
                    a, k = group(k)
                    done.append(f"{{{a}}}")
                elif x.startswith("\\"):
                    if x not in words:
                        raise Unknown(x)
                    done.append(words[x])
                    k += 1
                elif x == "}":
                    raise Unknown("braces")
                else:
                    done.append(x)
                    k += 1
        finally:
            t = keep
        return " ".join(done)

    try:
        return walk(t)
    except Unknown:
        return None


@F.pandas_udf(StringType())
def compare_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """``compare`` on columns, batch by batch."""
    return pd.Series([compare(x, y) for x, y in zip(a, b)], dtype="object")


@F.pandas_udf(StringType())
def linear_udf(a: pd.Series) -> pd.Series:
    """``linear`` on a column (M9)."""
    return pd.Series([linear(x) for x in a], dtype="object")


@F.pandas_udf(ArrayType(StringType()))
def solve_udf(a: pd.Series) -> pd.Series:
    """``solve`` on a column, solutions as text."""
    return pd.Series([None if (r := solve(x)) is None else [str(k) for k in r] for x in a], dtype="object")
