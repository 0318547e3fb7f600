"""Equality of arithmetic expressions with names, such as ``x+1`` and ``1+x``.

An expression is a fraction of polynomials in its names. Two of them are equal if they have
the same value at points where every name is replaced by a fixed pseudo-random number, in
exact arithmetic modulo large primes: different fractions of degree d agree at a point with
a probability of about d / 2^31, and three points with a prime each are compared. Nothing is
expanded, so powers and products of sums cost no more than their tokens.

Values are fractions of residues, so a division costs two products and no inverse. The second
and third prime are only for pairs that are equal modulo the first.

The parser is one fold over the tokens, a step each. Its state has a sum, a product and the
value that a power may raise, each with the operator that waits for its right side, and the
same three of every parenthesis around them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspool.functions.binding import let
from larkspool.functions.text import FRACTION

#: Three large primes below 2^31; products of two residues fit a bigint.
PRIMES = (2147483647, 2147483629, 2147483587)
#: Names that stand for something else than an unknown number.
NOT_NAMES = ("I", "oo", "zoo", "nan")

_NUMBER = r"(?:(?:0+|[1-9][0-9]*)(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]{1,9})?(?![0-9A-Za-z_.])"
_NAME = r"[A-Za-z_][A-Za-z0-9_]*+"
_OPERATOR = r"[-+*/^()]"
_TOKEN = rf"({_NUMBER}|{_NAME}|{_OPERATOR})"
_EXPRESSION = rf"^\s*+(?:(?:{_NUMBER}|{_NAME}|{_OPERATOR})\s*+)++$"
_NO_EXPRESSION = rf"\(\s*\)|(?<![A-Za-z0-9_])(?:{'|'.join(NOT_NAMES)})(?![A-Za-z0-9_])"
# A token's kind is its place among the operators, 0 for numbers and names; RAISED marks a value that is a power.
_OPERATORS = "+-*/^()"
_PLUS, _MINUS, _TIMES, _OVER, _POWER, _OPEN, _CLOSE = range(1, 8)
_RAISED = 8
_PART = "struct<v:bigint,d:bigint,n:bigint,op:int>"
_LEVEL = f"s:{_PART},m:{_PART},w:{_PART}"
_STATE = f"struct<outer:array<struct<{_LEVEL}>>,{_LEVEL}>"


def _power(base: Column, exponent: Column, p: Column) -> Column:
    """``base ** exponent`` modulo p by squaring, for an exponent from 0 to p - 1."""
    def step(state: Column, _: Column) -> Column:
        out = F.when(state["e"] % 2 == 1, state["out"] * state["base"] % p).otherwise(state["out"])
        return F.struct(out.alias("out"), (state["base"] * state["base"] % p).alias("base"), F.shiftright(state["e"], 1).alias("e"))

    start = F.struct(F.lit(1).cast("bigint").alias("out"), base.alias("base"), exponent.cast("bigint").alias("e"))
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(exponent))), start, step, lambda end: end["out"])


def _tokens(text: Column) -> Column:
    """Kinds of the tokens, with what is the same for all primes: names, short integers, digits in groups and powers of ten."""
    text = F.replace(text, F.lit("**"), F.lit("^"))
    text = F.regexp_replace(text, r"([*/])\s*-", "$1(-1)$1")
    text = F.regexp_replace(text, r"\^\s*-\s*([0-9]+)", "^(-$1)")

    none = {"name": F.lit(None).cast("string"), "n": F.lit(None).cast("bigint"), "groups": F.lit(None).cast("array<bigint>"), "power": F.lit(0).cast("bigint")}

    def found(kind: Column | int, **known: Column) -> Column:
        return F.struct(*(value.alias(name) for name, value in {"kind": kind, **none, **known}.items()))

    def long_number(token: Column) -> Column:
        whole = F.regexp_extract(token, r"^([0-9]*)", 1)
        rest = F.regexp_extract(token, r"^[0-9]*\.([0-9]*)", 1)
        power = F.coalesce(F.regexp_extract(token, r"[eE]([+-]?[0-9]+)$", 1).try_cast("bigint"), F.lit(0)) - F.length(rest)
        digits = F.concat(whole, rest)
        groups = F.regexp_extract_all(F.lpad(digits, F.ceil(F.length(digits) / 9) * 9, F.lit("0")), F.lit("([0-9]{9})"), F.lit(1))
        return found(F.lit(0), groups=F.transform(groups, lambda g: g.cast("bigint")), power=power)

    def number(token: Column) -> Column:
        short = F.regexp_like(token, F.lit("^[0-9]{1,15}$"))
        return F.when(short, found(F.lit(0), n=token.cast("bigint"))).otherwise(long_number(token))

    def parsed(token: Column) -> Column:
        operator = let(F.instr(F.lit(_OPERATORS), token), lambda kind: F.when(kind > 0, found(kind)).otherwise(number(token)))
        # Letters and _ come behind all other characters of tokens but ^.
        return F.when((token >= "A") & (token != "^"), found(F.lit(0), name=token)).otherwise(operator)

    return F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1)), parsed)


def _part(v: Column, d: Column, n: Column, op: Column) -> Column:
    """A fraction v / d modulo a prime, its value n if it is a known integer, and the operator behind it."""
    return F.struct(v.cast("bigint").alias("v"), d.cast("bigint").alias("d"), n.cast("bigint").alias("n"), op.cast("int").alias("op"))


def _with_op(part: Column, op: Column) -> Column:
    return _part(part["v"], part["d"], part["n"], op)


def _value(token: Column, p: Column) -> Column:
    """The value of a number of any length or of a name."""
    one, none, zero = F.lit(1), F.lit(None), F.lit(0)
    residue = F.aggregate(token["groups"], F.lit(0).cast("bigint"), lambda v, g: (v * 1_000_000_000 + g) % p)
    scale = _power(F.lit(10).cast("bigint"), F.abs(token["power"] % (p - 1)), p)

    def scaled(v: Column, ten: Column) -> Column:
        return F.when(token["power"] < 0, _part(v, ten, none, zero)).otherwise(_part(v * ten % p, one, none, zero))

    return (
        F.when(token["n"].isNotNull(), _part(token["n"] % p, one, token["n"], zero))
        .when(token["name"].isNotNull(), _part(F.pmod(F.xxhash64(token["name"], p), p), one, none, zero))
        .otherwise(let(residue, lambda v: let(scale, lambda ten: scaled(v, ten))))
    )


def _raised(base: Column, n: Column, p: Column) -> Column:
    """A power; a power of zero is no residue of an exponent modulo p - 1 and left out."""
    def powers(e: Column) -> Column:
        top, bottom = _power(base["v"], e, p), F.when(base["d"] == 1, base["d"]).otherwise(_power(base["d"], e, p))
        none, op = F.lit(None), F.lit(_RAISED)
        return F.when(n < 0, _part(bottom, top, none, op)).otherwise(_part(top, bottom, none, op))

    return F.when(n.isNotNull() & (base["v"] != 0), let(F.abs(n % (p - 1)), powers))


def _multiplied(product: Column, value: Column, p: Column) -> Column:
    """The product with one more factor or divisor; null if that is zero."""
    a, b, op = product, value, F.lit(0)
    times = _part(a["v"] * b["v"] % p, a["d"] * b["d"] % p, F.try_multiply(a["n"], b["n"]), op)
    over = _part(a["v"] * b["d"] % p, a["d"] * b["v"] % p, F.lit(None), op)
    return F.when(a["v"].isNull(), b).when(a["op"] == _TIMES, times).when(b["v"] != 0, over)


def _added(total: Column, product: Column, p: Column, op: Column) -> Column:
    """The sum with one more product, and the operator that comes next."""
    a, b = total, product
    sign = F.when(a["op"] == _MINUS, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    first = _part(F.pmod(sign * b["v"], p), b["d"], F.try_multiply(sign, b["n"]), op)
    more = _part(
        F.pmod(a["v"] * b["d"] + sign * b["v"] * a["d"], p), a["d"] * b["d"] % p, F.try_add(a["n"], F.try_multiply(sign, b["n"])), op
    )
    return F.when(a["v"].isNull(), first).otherwise(more)


def _total(level: Column, p: Column, op: Column) -> Column:
    """The sum with all that stands behind it; null if a right side is missing."""
    complete = level["w"]["v"].isNotNull() & (level["w"]["op"] != _POWER)
    whole = let(_multiplied(level["m"], level["w"], p), lambda m: F.when(m.isNotNull(), _added(level["s"], m, p, op)))
    return F.when(complete, F.when(level["m"]["v"].isNull(), _added(level["s"], level["w"], p, op)).otherwise(whole))


def _evaluated(tokens: Column, p: Column) -> Column:
    """The value of an expression modulo p; null if it isn't one."""
    empty = _part(F.lit(None), F.lit(1), F.lit(None), F.lit(0))

    def state_of(outer: Column, s: Column, m: Column, w: Column) -> Column:
        return F.struct(outer.alias("outer"), s.alias("s"), m.alias("m"), w.alias("w"))

    def met(level: Column, outer: Column, value: Column) -> Column:
        """The state after a value, which is a power's base or its exponent."""
        w = level["w"]
        raised = let(_raised(w, value["n"], p), lambda x: F.when(x.isNotNull(), state_of(outer, level["s"], level["m"], x)))
        return F.when(w["v"].isNull(), state_of(outer, level["s"], level["m"], value)).when(w["op"] == _POWER, raised)

    def step(state: Column, token: Column) -> Column:
        kind, outer, s, m, w = token["kind"], state["outer"], state["s"], state["m"], state["w"]
        # Signs in a row make one.
        sign = F.when((s["op"] == _MINUS) != (kind == _MINUS), F.lit(_MINUS)).otherwise(F.lit(_PLUS))
        signed = F.when(m["v"].isNull(), state_of(outer, _with_op(s, sign), m, w))
        summed = let(_total(state, p, kind), lambda x: F.when(x.isNotNull(), state_of(outer, x, empty, empty)))
        multiplied = let(_multiplied(m, w, p), lambda x: F.when(x.isNotNull(), state_of(outer, s, _with_op(x, kind), empty)))
        product = F.when(m["v"].isNull(), state_of(outer, s, _with_op(w, kind), empty)).otherwise(multiplied)
        inside = state_of(F.concat(outer, F.array(F.struct(s.alias("s"), m.alias("m"), w.alias("w")))), empty, empty, empty)

        def closed(value: Column) -> Column:
            rest = F.slice(outer, 1, F.size(outer) - 1)
            return F.when(value.isNotNull(), let(F.get(outer, F.size(outer) - 1), lambda level: met(level, rest, value)))

        return (
            F.when(state.isNull(), state)
            .when(kind == 0, let(_value(token, p), lambda value: met(state, outer, value)))
            .when(kind <= _MINUS, F.when(w["v"].isNull(), signed).otherwise(summed))
            .when(kind <= _OVER, F.when(w["v"].isNotNull() & (w["op"] != _POWER), product))
            .when(kind == _POWER, F.when(w["v"].isNotNull() & (w["op"] == 0), state_of(outer, s, m, _with_op(w, kind))))
            .when(kind == _OPEN, inside)
            .when(F.size(outer) > 0, let(_total(state, p, F.lit(0)), closed))
        )

    start = state_of(F.array(), empty, empty, empty).cast(_STATE)
    end = F.aggregate(tokens, start, step)
    return let(end, lambda state: F.when(F.size(state["outer"]) == 0, _total(state, p, F.lit(0))))


def algebra_equal(left: Column, right: Column) -> Column:
    """Whether two texts are expressions of numbers and names with ``+ - * / ^ **`` and parentheses and have the same value.

    Exponents are integers (or sums and products of them). Anything else is not equal: other
    characters, a number right in front of a name, a function call, a division by zero, a power of a
    power, a power of zero. Two numbers or fractions of them, and texts without any operator, are left to the other rules.
    """
    def fits(text: Column) -> Column:
        return F.regexp_like(text, F.lit(_EXPRESSION)) & ~F.regexp_like(text, F.lit(_NO_EXPRESSION))

    operator = F.regexp_like(left, F.lit(_OPERATOR)) | F.regexp_like(right, F.lit(_OPERATOR))
    numbers = F.regexp_like(left, F.lit(FRACTION)) & F.regexp_like(right, F.lit(FRACTION))
    primes = F.array(*(F.lit(p).cast("bigint") for p in PRIMES))

    def same(values: Column, p: Column) -> Column:
        a, b = values[0], values[1]
        return F.coalesce(a["v"] * b["d"] % p == b["v"] * a["d"] % p, F.lit(False))

    def equal(sides: Column) -> Column:
        return F.forall(primes, lambda p: let(F.transform(sides, lambda tokens: _evaluated(tokens, p)), lambda values: same(values, p)))

    both = let(F.transform(F.array(left, right), _tokens), equal)
    return F.coalesce(F.when(operator & ~numbers & fits(left) & fits(right), both), F.lit(False))
