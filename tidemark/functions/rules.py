"""Rule strings as boolean columns.

A rule is compared bar by bar. A missing value is NULL: arithmetic hands it on, every comparison with it
is false, `not` of it is false, and a number counts as true above 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import typical_prices
from tidemark.schemas import KEYS

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.?\d*|\.\d+)|(?P<name>[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)*)|(?P<op>[<>=!]=|[<>+\-*/()\[\],]))")
_PRICES = ("open", "high", "low", "close", "volume")
_BUILT_IN = {*_PRICES, "hl2", "hlc3", "ohlc4", "bar_index", "na"}
# Functions by name, with the numbers of arguments they take.
CALLS = {"ta.crossover": (2,), "ta.crossunder": (2,), "ta.cross": (2,), "nz": (1, 2), "abs": (1,), "math.abs": (1,), "math.sign": (1,)}
CALLS |= {f"{p}{f}": (2,) for p in ("", "math.") for f in ("min", "max")} | {"barstate.isconfirmed": (0,)}


class RuleError(ValueError):
    """A rule that cannot be read or evaluated."""


@dataclass(frozen=True)
class Expr:
    """A column of numbers (NULL is missing) or of truth values (never NULL)."""

    column: Column
    truth: bool = False

    @property
    def number(self) -> Column:
        return self.column.cast("double") if self.truth else self.column

    @property
    def bool(self) -> Column:
        return self.column if self.truth else F.coalesce(self.column > 0.5, F.lit(False))


def window(keys: Sequence[str] = KEYS):
    return Window.partitionBy(*keys).orderBy("timestamp")


def history(x: Column, n: int, keys: Sequence[str] = KEYS) -> Column:
    """x of n bars before."""
    return F.lag(x, n).over(window(keys)) if n else x


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def crossover(x: Column, y: Column, keys: Sequence[str] = KEYS) -> Column:
    return _sure((x > y) & (history(x, 1, keys) <= history(y, 1, keys)))


def crossunder(x: Column, y: Column, keys: Sequence[str] = KEYS) -> Column:
    return _sure((x < y) & (history(x, 1, keys) >= history(y, 1, keys)))


def cross(x: Column, y: Column, keys: Sequence[str] = KEYS) -> Column:
    """Whether x > y has changed since the last bar, missing being false: so it fires on the first bar of a warm series."""
    above = _sure(x > y)
    return _sure(above != history(above, 1, keys))


def _clean(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def _divide(a: Column, b: Column) -> Column:
    infinite = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b != 0, _clean(a / b)).when(b == 0, infinite)


def _both(f, a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), f(a, b))


_BLANK = Expr(None)


class Rule:
    """Reads one rule from left to right. On its own it only checks the rule and lists its names and calls; subclasses give the parts a value."""

    def __init__(self, text: str):
        self.names, self.calls = [], []
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise RuleError(f"unexpected character {text[at:].strip()[:1]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        kind, word = self.peek()
        if word in wanted and kind in ("op", "name"):
            self.at += 1
            return word
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise RuleError(f"expected {word!r} before {self.peek()[1] or 'the end'!r}")

    def whole(self):
        out = self.level(0)
        if self.peek()[0] != "end":
            raise RuleError(f"unexpected {self.peek()[1]!r}")
        return out

    LEVELS = (("or",), ("and",), ("<", "<=", ">", ">=", "==", "!="), ("+", "-"), ("*", "/"))

    def level(self, n: int):
        if n == len(self.LEVELS):
            return self.prefixed()
        left = self.level(n + 1)
        while op := self.take(*self.LEVELS[n]):
            left = self.join(op, left, self.level(n + 1))
        return left

    def prefixed(self):
        if self.take("not"):
            return self.opposite(self.prefixed())
        if self.take("-"):
            return self.negative(self.prefixed())
        out = self.primary()
        while self.take("["):
            kind, word = self.peek()
            if kind != "num" or not word.isdigit():
                raise RuleError("history needs a whole number")
            self.at += 1
            self.need("]")
            out = self.before(out, int(word))
        return out

    def primary(self):
        kind, word = self.peek()
        self.at += 1
        if kind == "num":
            return self.literal(float(word))
        if word == "(" and kind == "op":
            out = self.level(0)
            self.need(")")
            return out
        if kind != "name" or word in ("and", "or", "not"):
            raise RuleError(f"unexpected {word or 'end'!r}")
        if not self.take("("):
            return self.name(word)
        args = []
        while not self.take(")"):
            if args:
                self.need(",")
            args.append(self.level(0))
        if word not in CALLS:
            self.calls.append(word)
        elif len(args) not in CALLS[word]:
            raise RuleError(f"{word} takes {' or '.join(map(str, CALLS[word]))} arguments")
        return self.call(word, args)

    def name(self, word: str):
        if not word.startswith("barstate."):
            self.names.append(word)
        return _BLANK

    def literal(self, value: float):
        return _BLANK

    def opposite(self, x):
        return _BLANK

    def negative(self, x):
        return _BLANK

    def before(self, x, n: int):
        return _BLANK

    def join(self, op: str, a, b):
        return _BLANK

    def call(self, name: str, args: list):
        return _BLANK

    def value(self):
        """The value of the whole rule; a name or call without one is an error."""
        out = self.whole()
        if unresolved := [*self.names, *(f"call:{c}" for c in self.calls)]:
            raise RuleError(f"unresolved: {', '.join(unresolved)}")
        return out


class ColumnRule(Rule):
    """A rule as an Expr; `resolve` gives a column for a name, or None where it has none."""

    def __init__(self, text: str, resolve, keys: Sequence[str]):
        super().__init__(text)
        self.keys, self.resolve = keys, resolve

    def literal(self, value: float) -> Expr:
        return Expr(F.lit(value))

    def opposite(self, x: Expr) -> Expr:
        return Expr(~x.column if x.truth else _sure(x.column <= 0.5), True)

    def negative(self, x: Expr) -> Expr:
        return Expr(-x.number)

    def before(self, x: Expr, n: int) -> Expr:
        return Expr(history(x.number, n, self.keys))

    def name(self, word: str) -> Expr:
        if word == "na":
            return Expr(F.lit(None).cast("double"))
        if word.startswith("barstate."):
            return Expr(F.lit(1.0))
        if word == "bar_index":
            return Expr((F.row_number().over(window(self.keys)) - 1).cast("double"))
        found = self.resolve(word)
        if found is None and word in typical_prices():
            found = typical_prices()[word]
        if found is None and word not in _PRICES:
            self.names.append(word)
        return Expr(F.col(word) if found is None and word in _PRICES else F.lit(None).cast("double") if found is None else found)

    def join(self, op: str, a: Expr, b: Expr) -> Expr:
        if op in ("and", "or"):
            return Expr(a.bool & b.bool if op == "and" else a.bool | b.bool, True)
        x, y = a.number, b.number
        tests = {"<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y, "==": lambda: x == y, "!=": lambda: x != y}
        if op in tests:
            return Expr(_sure(tests[op]()), True)
        return Expr(_divide(x, y) if op == "/" else _clean({"+": x + y, "-": x - y, "*": x * y}[op]))

    def call(self, name: str, args: list[Expr]) -> Expr:
        if name not in CALLS:
            return Expr(F.lit(None).cast("double"))
        x = [a.number for a in args]
        if name.startswith("ta."):
            return Expr({"ta.crossover": crossover, "ta.crossunder": crossunder, "ta.cross": cross}[name](*x, self.keys), True)
        if name == "nz":
            return Expr(F.coalesce(x[0], x[1] if len(x) > 1 else F.lit(0.0)))
        if name == "barstate.isconfirmed":
            return Expr(F.lit(1.0))
        short = name.removeprefix("math.")
        return Expr({"abs": lambda: F.abs(x[0]), "sign": lambda: F.signum(x[0]), "min": lambda: _both(F.least, *x), "max": lambda: _both(F.greatest, *x)}[short]())


def rule_identifiers(rule: str) -> list[str]:
    """The names in a rule that are neither prices nor other built-in ones, in order of appearance."""
    r = Rule(rule)
    r.whole()
    return [n for n in dict.fromkeys(r.names) if n not in _BUILT_IN]


def unknown_calls(rule: str) -> list[str]:
    r = Rule(rule)
    r.whole()
    return list(dict.fromkeys(r.calls))


def rule_column(rule: str, columns: Sequence[str], keys: Sequence[str] = KEYS, names: dict[str, Column] | None = None) -> Column:
    """The rule as a truth value of each bar; a dotted name `a.b` is the column `a__b`, or field b of the struct a. `names` come before columns."""

    def resolve(name: str) -> Column | None:
        flat = name.replace(".", "__")
        if names and flat in names:
            return names[flat]
        if flat in columns:
            return F.col(flat)
        base = name.split(".")[0]
        return F.col(name) if "." in name and base in columns else None

    return ColumnRule(rule, resolve, keys).value().bool


def rule_filter(df: DataFrame, rule: str, keys: Sequence[str] = KEYS, name: str = "signal") -> DataFrame:
    """df with the rule's truth value in column `name`."""
    return df.withColumn(name, rule_column(rule, df.columns, keys))
