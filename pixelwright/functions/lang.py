"""Transfer-function language: text -> syntax tree -> Spark Column, SQL text or Python value.

Grammar (one variable, x; identifiers in lower case):

    list  = choice { "," choice }              the right operand is the value
    choice = sum [ ("<" | "<=" | ">" | ">=") sum "?" choice ":" choice ]
    sum   = product { ("+" | "-") product }
    product = power { ("*" | "/" | "%") power }
    power = signed { "^" signed }              left-associative
    signed = { "+" | "-" } base                a sign binds tighter than "^"
    base  = number | name | function signed | function "(" list ")" | "(" list ")"

A condition compares x with a constant, which is rounded to six decimals. At equality the
branches of "<" and "<=" take the second value, those of ">" and ">=" the first. log is the
common logarithm, ln the natural one; % is the remainder with the sign of the dividend.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([a-z][a-z0-9_]*)|(<=|>=|[-+*/^%(),<>?:]))")

CONSTANTS = {"pi": math.pi, "e": math.e}

#: name -> (arguments, Column builder, SQL text, Python function)
FUNCTIONS = {
    "abs": (1, F.abs, "abs({0})", abs),
    "acos": (1, F.acos, "acos({0})", math.acos),
    "asin": (1, F.asin, "asin({0})", math.asin),
    "atan": (1, F.atan, "atan({0})", math.atan),
    "atan2": (2, F.atan2, "atan2({0}, {1})", math.atan2),
    "ceil": (1, lambda a: F.ceil(a).cast("double"), "ceil({0})", math.ceil),
    "cos": (1, F.cos, "cos({0})", math.cos),
    "cosh": (1, F.cosh, "cosh({0})", math.cosh),
    "exp": (1, F.exp, "exp({0})", math.exp),
    "fac": (1, lambda a: F.factorial(F.floor(a).cast("int")).cast("double"), "CAST(factorial(CAST(floor({0}) AS INT)) AS DOUBLE)", lambda a: float(math.factorial(int(a)))),
    "floor": (1, lambda a: F.floor(a).cast("double"), "floor({0})", math.floor),
    "ln": (1, F.ln, "ln({0})", math.log),
    "log": (1, F.log10, "log10({0})", math.log10),
    "log10": (1, F.log10, "log10({0})", math.log10),
    "pow": (2, F.pow, "pow({0}, {1})", math.pow),
    "sin": (1, F.sin, "sin({0})", math.sin),
    "sinh": (1, F.sinh, "sinh({0})", math.sinh),
    "sqrt": (1, F.sqrt, "sqrt({0})", math.sqrt),
    "tan": (1, F.tan, "tan({0})", math.tan),
    "tanh": (1, F.tanh, "tanh({0})", math.tanh),
    "ncr": (2, lambda n, k: _ncr(n, k), "round(exp(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)))", lambda n, k: float(math.comb(int(n), int(k)))),
    "npr": (2, lambda n, k: _factorial(n) / _factorial(n - k), "round(exp(lgamma({0} + 1) - lgamma({0} - {1} + 1)))", lambda n, k: float(math.perm(int(n), int(k)))),
    "split": (4, lambda x, c, a, b: F.when(x < c, a).otherwise(b), "(CASE WHEN {0} < {1} THEN {2} ELSE {3} END)", lambda x, c, a, b: a if x < c else b),
}


def _factorial(n: Column) -> Column:
    return F.factorial(n.cast("int")).cast("double")


def _ncr(n: Column, k: Column) -> Column:
    return F.round(_factorial(n) / (_factorial(k) * _factorial(n - k)))


def register(name: str, arity: int, column, sql: str, python) -> None:
    """Bind a user function: a Column builder, SQL text with {0}, {1} ... and a Python function."""
    if not re.fullmatch(r"[a-z][a-z0-9_]*", name) or name in CONSTANTS or name == "x" or not 1 <= arity <= 7:
        raise ValueError(f"cannot bind {name}/{arity}")
    FUNCTIONS[name] = (arity, column, sql, python)


class ExpressionError(ValueError):
    """A text that is not in the language; position is the offending character's."""

    def __init__(self, text: str, position: int):
        super().__init__(f"cannot read {text!r} at character {position}")
        self.position = position


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    args: tuple["Node", ...] = ()


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError(text, at)
            self.tokens.append((m.lastindex, m[m.lastindex], m.start(m.lastindex)))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def fail(self) -> ExpressionError:
        return ExpressionError(self.text, self.tokens[self.at][2] if self.at < len(self.tokens) else len(self.text))

    def take(self, *wanted: str) -> str:
        found = self.peek()
        if found is None or (wanted and found not in wanted):
            raise self.fail()
        self.at += 1
        return found

    def binary(self, below, *operators: str) -> Node:
        node = below()
        while self.peek() in operators:
            node = Node("op", self.take(), (node, below()))
        return node

    def list_(self) -> Node:
        node = self.choice()
        while self.peek() == ",":
            self.take()
            node = self.choice()
        return node

    def choice(self) -> Node:
        node = self.sum()
        if self.peek() == "?" and node.kind == "compare":
            return self.branches(node)
        if self.peek() in ("<", "<=", ">", ">="):
            node = Node("compare", self.take(), (node, self.sum()))
            if self.peek() == "?":
                return self.branches(node)
        return node

    def branches(self, compare: Node) -> Node:
        self.take("?")
        a = self.choice()
        self.take(":")
        b = self.choice()
        left, right = compare.args
        cut = fold(right)
        if left != Node("x") or cut.kind != "number":
            raise self.fail()
        if compare.value[0] == ">":
            a, b = b, a
        return Node("call", "split", (left, Node("number", round(cut.value, 6)), a, b))

    def sum(self) -> Node:
        return self.binary(self.product, "+", "-")

    def product(self) -> Node:
        return self.binary(self.power, "*", "/", "%")

    def power(self) -> Node:
        return self.binary(self.signed, "^")

    def signed(self) -> Node:
        negative = False
        while self.peek() in ("+", "-"):
            negative ^= self.take() == "-"
        node = self.base()
        return Node("negate", None, (node,)) if negative else node

    def base(self) -> Node:
        if self.at >= len(self.tokens):
            raise self.fail()
        kind, value, _ = self.tokens[self.at]
        if kind == 1:
            self.at += 1
            return Node("number", float(value))
        if value == "(":
            self.take()
            node = self.list_()
            self.take(")")
            return node
        if kind != 2:
            raise self.fail()
        if value == "x":
            self.at += 1
            return Node("x")
        if value in CONSTANTS:
            self.at += 1
            if self.peek() == "(":  # constants may be written as calls
                self.take(), self.take(")")
            return Node("number", CONSTANTS[value])
        if value not in FUNCTIONS:
            raise self.fail()
        self.at += 1
        n = FUNCTIONS[value][0]
        if n == 1:
            return Node("call", value, (self.signed(),))
        self.take("(")
        args = [self.choice()]
        for _ in range(n - 1):
            self.take(",")
            args.append(self.choice())
        self.take(")")
        return Node("call", value, tuple(args))


def parse(text: str) -> Node:
    """The constant-folded syntax tree of a text."""
    p = _Parser(text)
    node = p.list_()
    if p.peek() is not None or node.kind == "compare":
        raise p.fail()
    return fold(node)


def fold(node: Node) -> Node:
    """Replace parts without x by their values."""
    args = tuple(map(fold, node.args))
    node = Node(node.kind, node.value, args)
    if args and all(a.kind == "number" for a in args) and node.kind != "compare":
        try:
            return Node("number", float(evaluate(node, 0.0)))
        except (ValueError, OverflowError, ZeroDivisionError):
            return node
    return node


def evaluate(node: Node, x: float) -> float:
    """The value at x, in Python."""
    if node.kind == "number":
        return node.value
    if node.kind == "x":
        return x
    args = [evaluate(a, x) for a in node.args] if node.value != "split" else []
    if node.kind == "negate":
        return -args[0]
    if node.kind == "call":
        if node.value == "split":
            a, c, below, above = node.args
            return evaluate(below if evaluate(a, x) < evaluate(c, x) else above, x)
        return FUNCTIONS[node.value][3](*args)
    a, b = args
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b), "^": lambda: math.pow(a, b)}[node.value]()


def column(node: Node, x: Column) -> Column:
    """The tree as a Catalyst expression of a double column."""
    if node.kind == "number":
        return F.lit(node.value)
    if node.kind == "x":
        return x
    args = [column(a, x) for a in node.args]
    if node.kind == "negate":
        return -args[0]
    if node.kind == "call":
        return FUNCTIONS[node.value][1](*args)
    a, b = args
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b, "^": lambda: F.pow(a, b)}[node.value]()


def sql(node: Node, x: str) -> str:
    """The tree as SQL text."""
    if node.kind == "number":
        return f"CAST({node.value!r} AS DOUBLE)"
    if node.kind == "x":
        return x
    args = [sql(a, x) for a in node.args]
    if node.kind == "negate":
        return f"(-{args[0]})"
    if node.kind == "call":
        return FUNCTIONS[node.value][2].format(*args)
    return f"pow({args[0]}, {args[1]})" if node.value == "^" else f"({args[0]} {node.value} {args[1]})"


def compile_column(text: str, x: Column) -> Column:
    return column(parse(text), x)


def compile_sql(text: str, x: str) -> str:
    return sql(parse(text), x)


#: Public transfer curves by their published formulas.
TONE_CURVES = {
    "none": "x",
    "reinhard": "(x < 0.0) ? x : x / (1.0 + x)",
    "tangent": "atan(x) / atan(8.0)",
    "alexa_log_c": "(x > 0.010591) ? (0.247190 * log10(5.555556 * x + 0.052272) + 0.385537) : (5.367655 * x + 0.092809)",
    "cineon_log": "((log10(x * (1.0 - 0.0108) + 0.0108)) * 300.0 + 685.0) / 1023.0",
    "sony_s_log3": "(x >= 0.01125000) ? (420.0 + log10((x + 0.01) / (0.18 + 0.01)) * 261.5) / 1023.0 : (x * (171.2102946929 - 95.0) / 0.01125000 + 95.0) / 1023.0",
    "srgb": "x < 0.0031308 ? x * 12.92 : (1.055 * pow(x, 1.0 / 2.4)) - 0.055",
    "rec709": "(x <= 0.018) ? (x * 4.5) : 1.099 * pow(x, (0.45)) - 0.099",
    "hlg": "(x <= 1.0) ? (sqrt(x) * 0.5) : 0.17883277 * ln(x - 0.28466892) + 0.55991073",
    "davinci_intermediate": "(x <= 0.00262409) ? (x * 10.44426855) : (log10(x + 0.0075) / log10(2) + 7.0) * 0.07329248",
    "reinhard_3_5": "(x < 0.4) ? x : (((x - 0.4) / 0.6) / (1.0 + (x - 0.4) / 0.6)) * 0.6 + 0.4",
    "canon_log": "0.529136 * log10(x * 10.1596 + 1.0) + 0.0730597",
}

#: Image profiles as (tone curve, power, gamut, creative adjustments, transfer text).
PROFILES = {
    "standard": ("none", 3.15, "rec709", True, "pow(x, 1/3.15)"),
    "tonemapped": ("reinhard", 3.15, "rec709", True, "(x < 0.0) ? 0 : pow(x / (1.0 + x), 1/3.15)"),
    "film": ("tangent", 3.465, "rec709", True, "pow(atan(x) / atan(8.0), 1/3.465)"),
    "alexa_log": ("alexa_log_c", 1.0, "alexa_wide_gamut", False, TONE_CURVES["alexa_log_c"]),
    "cineon_log": ("cineon_log", 1.0, "alexa_wide_gamut", False, TONE_CURVES["cineon_log"]),
    "sony_log_3": ("sony_s_log3", 1.0, "sony_s_gamut3", False, TONE_CURVES["sony_s_log3"]),
    "linear": ("none", 1.0, "rec709", False, "x"),
    "srgb": ("srgb", 1.0, "rec709", False, TONE_CURVES["srgb"]),
    "rec709": ("rec709", 1.0, "rec709", False, TONE_CURVES["rec709"]),
    "davinci_wide_gamut": ("davinci_intermediate", 1.0, "davinci_wide_gamut", False, TONE_CURVES["davinci_intermediate"]),
    "fuji_f_log": ("none", 1.0, "rec2020", False, "(x < 0.00089) ? (8.735631 * x + 0.092864) : (0.344676 * log10(0.555556 * x + 0.009468) + 0.790453)"),
    "canon_log": ("canon_log", 1.0, "canon_cinema", False, "(0.529136 * (log10 ( 10.1596 * x + 1 ))) + 0.0730597"),
    "panasonic_v_log": ("none", 1.0, "panasonic_v", False, "(x >= 0.01) ? (0.241514 * log10(x + 0.00873) + 0.598206) : (5.6 * x + 0.125)"),
}
