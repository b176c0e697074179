"""A per-pixel expression language, compiled to Spark columns.

Arithmetic, comparison, logic and bit operators, ``? :``, assignments separated by ``;``, the functions below,
constants, ``i j w h`` and the channels that a raster has. Truth is 1 or 0; samples are on the scale 0 to 1.
Loops have no column form and are refused.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|(\+=|-=|\*=|/=|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%^?:()<>=!&|~,;{}\[\]]))")
CONSTANTS = {"pi": math.pi, "e": math.e, "epsilon": 1e-12, "phi": 1.618033988749895, "quantumrange": 65535.0, "quantumscale": 1 / 65535.0, "maxrgb": 65535.0, "opaque": 1.0, "transparent": 0.0}
#: Binary operators by how tightly they bind, loosest first.
LEVELS = [["||"], ["&&"], ["|"], ["&"], ["==", "!="], ["<", "<=", ">", ">="], ["<<", ">>"], ["+", "-"], ["*", "/", "%"]]


def _truth(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _whole(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def _safe(c: Column) -> Column:
    return F.when(F.abs(c) < 1e-12, 1e12).otherwise(1.0 / c)


def _modulo(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) < 1e-12, 0.0).otherwise(a - F.floor(a / b) * b)


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a * _safe(b), "%": lambda a, b: a % F.abs(F.floor(b + 0.5)), "^": lambda a, b: F.pow(a, b),
    "<": lambda a, b: _truth(a < b), "<=": lambda a, b: _truth(a <= b), ">": lambda a, b: _truth(a > b), ">=": lambda a, b: _truth(a >= b), "==": lambda a, b: _truth(F.abs(a - b) < 1e-12), "!=": lambda a, b: _truth(F.abs(a - b) >= 1e-12),
    "&&": lambda a, b: _truth((a != 0) & (b != 0)), "||": lambda a, b: _truth((a != 0) | (b != 0)), "&": lambda a, b: _whole(a).bitwiseAND(_whole(b)).cast("double"), "|": lambda a, b: _whole(a).bitwiseOR(_whole(b)).cast("double"),
    "<<": lambda a, b: F.call_function("shiftleft", _whole(a), _whole(b).cast("int")).cast("double"), ">>": lambda a, b: F.call_function("shiftright", _whole(a), _whole(b).cast("int")).cast("double"),
}

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "acos": F.acos, "acosh": F.acosh, "asin": F.asin, "asinh": F.asinh, "atan": F.atan, "atanh": F.atanh, "atan2": F.atan2, "cos": F.cos, "cosh": F.cosh, "sin": F.sin, "sinh": F.sinh, "tan": F.tan, "tanh": F.tanh,
    "exp": F.exp, "ln": F.log, "log": F.log10, "logtwo": F.log2, "sqrt": F.sqrt, "pow": F.pow, "hypot": F.hypot, "isnan": lambda x: _truth(F.isnan(x)),
    "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "int": lambda x: F.floor(x).cast("double"), "round": lambda x: F.floor(x + 0.5).cast("double"), "trunc": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"),
    "alt": lambda x: F.when(F.floor(x).cast("long").bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0), "clamp": lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), "drc": lambda a, b: a / (b * (a - 1.0) + 1.0),
    "gauss": lambda x: F.exp(-x * x / 2.0) / math.sqrt(2 * math.pi), "max": F.greatest, "min": F.least, "mod": _modulo, "not": lambda x: _truth(x < 1e-12), "sign": lambda x: F.when(x < 0, -1.0).otherwise(1.0),
    "sinc": lambda x: F.when(x == 0, 1.0).otherwise(F.sin(math.pi * x) / (math.pi * x)), "squish": lambda x: 1.0 / (1.0 + F.exp(-x)), "if": lambda c, a, b: F.when(c != 0, a).otherwise(b), "debug": lambda x: x,
}
for _name in ("gcd",):  # Euclid's rule, over a sequence of remainders as long as numbers below 2^53 can need
    FUNCTIONS[_name] = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(_whole(F.abs(a)).alias("a"), _whole(F.abs(b)).alias("b")), lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % s["b"]).alias("b")), lambda s: s["a"].cast("double"))


class Compiler:
    """Recursive descent over the tokens; each rule returns a column."""

    def __init__(self, text: str, symbols: dict[str, Column]):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:]!r}")
            self.tokens.append(m)
            at = m.end()
        self.symbols, self.at = dict(symbols), 0

    def peek(self, group: int = 0) -> str | None:
        if self.at >= len(self.tokens):
            return None
        m = self.tokens[self.at]
        return m[group].strip() if group == 0 else m[group]

    def take(self, expected: str | None = None) -> str:
        token = self.peek()
        if token is None or expected is not None and token != expected:
            raise ValueError(f"expected {expected}, found {token}")
        self.at += 1
        return token

    def program(self) -> Column:
        out = self.statement()
        while self.peek() == ";":
            self.take()
            if self.peek() is not None:
                out = self.statement()
        if self.peek() is not None:
            raise ValueError(f"unexpected {self.peek()}")
        return out

    def statement(self) -> Column:
        name = self.peek(2)
        follow = self.tokens[self.at + 1][0].strip() if name and self.at + 1 < len(self.tokens) else None
        if follow in ("=", "+=", "-=", "*=", "/="):
            self.at += 2
            value = self.ternary()
            self.symbols[name.lower()] = value if follow == "=" else BINARY[follow[0]](self.symbols[name.lower()], value)
            return self.symbols[name.lower()]
        return self.ternary()

    def ternary(self) -> Column:
        test = self.binary(0)
        if self.peek() != "?":
            return test
        self.take()
        yes = self.ternary()
        self.take(":")
        return F.when(test != 0, yes).otherwise(self.ternary())

    def binary(self, level: int) -> Column:
        if level == len(LEVELS):
            return self.unary()
        out = self.binary(level + 1)
        while self.peek() in LEVELS[level]:
            out = BINARY[self.take()](out, self.binary(level + 1))
        return out

    def unary(self) -> Column:
        token = self.peek()
        if token in ("-", "+", "!", "~"):
            self.take()
            x = self.unary()
            return {"-": lambda: -x, "+": lambda: x, "!": lambda: _truth(x == 0), "~": lambda: F.bitwise_not(_whole(x)).cast("double")}[token]()
        base = self.primary()
        if self.peek() == "^":
            self.take()
            return F.pow(base, self.unary())
        return base

    def primary(self) -> Column:
        number, name = self.peek(1), self.peek(2)
        token = self.take()
        if number:
            return F.lit(float(number))
        if token == "(":
            out = self.ternary()
            self.take(")")
            return out
        if not name:
            raise ValueError(f"unexpected {token}")
        name = name.lower()
        if name in ("for", "while", "do"):
            raise ValueError(f"{name} has no column form")
        if self.peek() == "(":
            if name not in FUNCTIONS:
                raise ValueError(f"no function {name}")
            self.take()
            arguments = [self.ternary()]
            while self.peek() == ",":
                self.take()
                arguments.append(self.ternary())
            self.take(")")
            return FUNCTIONS[name](*arguments)
        if name in self.symbols:
            return self.symbols[name]
        if name in CONSTANTS:
            return F.lit(CONSTANTS[name])
        raise ValueError(f"no symbol {name}")


def compile_fx(text: str, symbols: dict[str, Column]) -> Column:
    return Compiler(text, symbols).program()


def fx(df: DataFrame, text: str, channel: str = "v") -> DataFrame:
    """The channel becomes QR times the expression's value; symbols are u and the channels (0 to 1), i and j."""
    symbols = {c: F.col(c) / 65535.0 for c in df.columns if c not in ("image_id", "scene", "y", "x")}
    symbols |= {"u": F.col(channel) / 65535.0, "i": F.col("x").cast("double"), "j": F.col("y").cast("double")}
    return df.withColumn(channel, 65535.0 * compile_fx(text, symbols))
