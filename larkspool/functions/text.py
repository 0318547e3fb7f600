"""Text expressions: normalization, boxed answers and answer comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspool.fixed_values import BOX_OPENING
from larkspool.functions.binding import let

# Every character that Unicode-aware text tools treat as white space, including
# the four ASCII separators U+001C..U+001F that Java's \s leaves out.
_SPACE = r"[\s\x1c-\x1f]"

# Tokens of a text that may hold boxes: an opening, a brace, plain text, a lone backslash.
_BOX_TOKENS = r"(\\boxed\{|[{}]|[^{}\\]+|\\)"
# A text whose boxes are all closed and have no braces inside, up to and from one box to the next; the group is the last content.
_BETWEEN = r"[^\\]*+(?:\\(?!boxed\{)[^\\]*+)*+"
_FLAT_BOXES = rf"\A{_BETWEEN}(?:\\boxed\{{([^{{}}]*+)\}}{_BETWEEN})++\z"

# Number literals. Integers have no leading zeros unless they are all zeros; an exponent may follow.
_NUMBER = r"[+-]?(?:0+|[1-9][0-9]*|[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,15})?"
FRACTION = rf"^\s*{_NUMBER}\s*(?:/\s*{_NUMBER}\s*)?$"
# Short numbers and fractions of them, whose cross products fit a decimal.
_SHORT = r"(?:0|[1-9][0-9]{0,8})(?:\.[0-9]{1,6})?"
_SHORT_FRACTION = rf"^[+-]?{_SHORT}(?:/{_SHORT})?$"
# What \s stands for in the patterns above.
_BLANKS = " \t\n\x0b\f\r"
# Decimal digits of one group in products of long numbers: a sum of many products of two groups fits a bigint.
_GROUP = 6


def normalize_text(text: Column) -> Column:
    """Lower-case text without any white space; null becomes the empty string."""
    return F.coalesce(F.regexp_replace(F.lower(text), f"(?U){_SPACE}+", ""), F.lit(""))


def has_text(text: Column) -> Column:
    """True if the normalized text is not empty; stops at the first character that is no white space."""
    return F.coalesce(F.regexp_like(text, F.lit(r"(?U)[^\s\x1c-\x1f]")), F.lit(False))


def strip_text(text: Column) -> Column:
    """Text without leading and trailing Unicode white space."""
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def boxed_answer(text: Column) -> Column:
    r"""Stripped content of the last complete ``\boxed{...}``; none gives ``''``.

    Braces nest to any depth and an inner box belongs to the content of the outer
    one. The fold keeps only integers (depth and offsets), so an unclosed box in
    front of a long text costs no string copies; the content is cut out once.
    Texts whose boxes have no braces inside, which are most, need one pattern and no fold.
    """
    def step(state: Column, token: Column) -> Column:
        depth, at = state["depth"], state["at"]
        opens = token == BOX_OPENING
        closes = (token == "}") & (depth == 1)
        return F.struct(
            F.when(opens | ((token == "{") & (depth > 0)), depth + 1)
            .when((token == "}") & (depth > 0), depth - 1)
            .otherwise(depth)
            .alias("depth"),
            (at + F.length(token)).alias("at"),
            F.when(opens & (depth == 0), at + len(BOX_OPENING)).otherwise(state["start"]).alias("start"),
            F.when(closes, state["start"]).otherwise(state["last"]).alias("last"),
            F.when(closes, at - state["start"]).otherwise(state["size"]).alias("size"),
        )

    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit(1).alias("at"),
        F.lit(0).alias("start"),
        F.lit(0).alias("last"),
        F.lit(0).alias("size"),
    )

    def last_box(tail: Column) -> Column:
        fold = F.aggregate(F.regexp_extract_all(tail, F.lit(_BOX_TOKENS), F.lit(1)), start, step)
        return let(fold, lambda box: F.when(box["last"] > 0, strip_text(F.substr(tail, box["last"], box["size"]))))

    nested = let(F.substr(text, F.locate(BOX_OPENING, text)), last_box)
    flat = strip_text(F.regexp_extract(text, _FLAT_BOXES, 1))
    found = let(flat, lambda content: F.when(content != "", content).otherwise(nested))
    return F.when(F.contains(text, F.lit(BOX_OPENING)), F.coalesce(found, F.lit(""))).otherwise(F.lit(""))


def clean_answer(answer: Column) -> Column:
    """Lower-case answer without spaces, ``$`` and ``,`` and without trailing dots."""
    return F.rtrim(F.translate(F.lower(answer), " $,", ""), F.lit("."))


def _parsed(number: Column) -> Column:
    """A number literal as its sign, its digits without zeros around them, and the power of ten of the last one."""
    whole = F.regexp_extract(number, r"^\s*[+-]?([0-9]*)", 1)
    rest = F.regexp_extract(number, r"^\s*[+-]?[0-9]*\.([0-9]*)", 1)
    power = F.coalesce(F.regexp_extract(number, r"[eE]([+-]?[0-9]+)\s*$", 1).try_cast("bigint"), F.lit(0))

    def stripped(found: Column) -> Column:
        digits = F.ltrim(F.rtrim(found["digits"], F.lit("0")), F.lit("0"))
        zero = digits == ""
        zeros = F.length(found["digits"]) - F.length(F.rtrim(found["digits"], F.lit("0")))
        return F.struct(
            (~zero & found["negative"]).alias("negative"),
            digits.alias("digits"),
            F.when(zero, F.lit(0)).otherwise(found["power"] - found["decimals"] + zeros).cast("bigint").alias("power"),
        )

    found = F.struct(
        F.startswith(F.ltrim(number, F.lit(_BLANKS)), F.lit("-")).alias("negative"),
        F.concat(whole, rest).alias("digits"),
        F.length(rest).alias("decimals"),
        power.alias("power"),
    )
    return let(found, stripped)


def _groups(digits: Column) -> Column:
    """Groups of digits as numbers, the lowest first."""
    size = F.ceil(F.length(digits) / _GROUP) * _GROUP
    found = F.regexp_extract_all(F.lpad(digits, size, F.lit("0")), F.lit(f"([0-9]{{{_GROUP}}})"), F.lit(1))
    return F.transform(F.reverse(found), lambda g: g.cast("bigint"))


def _long_product(left: Column, right: Column) -> Column:
    """Digits of the product of two digit strings of any length that are not empty."""
    def multiplied(x: Column, y: Column) -> Column:
        n, m, base = F.size(x), F.size(y), F.lit(10**_GROUP)
        sums = F.transform(
            F.sequence(F.lit(0), n + m - 2),
            lambda k: F.aggregate(
                F.sequence(F.greatest(F.lit(0), k - m + 1), F.least(k, n - 1)),
                F.lit(0).cast("bigint"),
                lambda total, i: total + F.get(x, i) * F.get(y, k - i),
            ),
        )

        def carry(state: Column, value: Column) -> Column:
            total = state["carry"] + value
            low = F.lpad((total % base).cast("string"), _GROUP, F.lit("0"))
            return F.struct(F.floor(total / base).alias("carry"), F.concat(low, state["digits"]).alias("digits"))

        start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit("").alias("digits"))
        return F.aggregate(
            sums, start, carry,
            lambda end: F.regexp_replace(F.concat(end["carry"].cast("string"), end["digits"]), "^0+", ""),
        )

    return let(_groups(left), lambda x: let(_groups(right), lambda y: multiplied(x, y)))


def _product(left: Column, right: Column) -> Column:
    short = (F.length(left) <= 18) & (F.length(right) <= 18)
    quick = (left.try_cast("decimal(18,0)") * right.try_cast("decimal(18,0)")).cast("string")
    zero = (left == "") | (right == "")
    return F.when(zero, F.lit("")).when(short, quick).otherwise(_long_product(left, right))


def _crossed(top: Column, bottom: Column) -> Column:
    """Digits without zeros at the end, and power of ten, of the product of two parsed numbers."""
    def stripped(digits: Column) -> Column:
        bare = F.rtrim(digits, F.lit("0"))
        power = top["power"] + bottom["power"] + F.length(digits) - F.length(bare)
        return F.struct(bare.alias("digits"), F.when(bare == "", F.lit(0)).otherwise(power).cast("bigint").alias("power"))

    return let(_product(top["digits"], bottom["digits"]), stripped)


def _short_equal(left: Column, right: Column) -> Column:
    """Equality of two short fractions, in decimals of the generated code."""
    def parts(number: Column) -> tuple[Column, Column]:
        top, bottom = (F.split_part(number, F.lit("/"), F.lit(i)) for i in (1, 2))
        return top.try_cast("decimal(15,6)"), F.when(bottom == "", F.lit("1")).otherwise(bottom).try_cast("decimal(15,6)")

    (a, b), (c, d) = parts(left), parts(right)
    crossed = (b != 0) & (d != 0) & (a * d == c * b)
    return F.when(F.contains(left, F.lit("/")) | F.contains(right, F.lit("/")), crossed).otherwise(a == c)


def numeric_equal(left: Column, right: Column) -> Column:
    """Exact equality of two numbers written as integer, decimal, with an exponent, or as ``a/b``.

    Numbers compare by their digits and power of ten, fractions by cross
    multiplication, with any number of digits. Everything else, a zero
    denominator and an exponent of more than 15 digits are not equal. Short
    numbers compare as decimals; others are parsed once per row and side, and
    only if both sides are numbers.
    """
    one = F.struct(F.lit(False).alias("negative"), F.lit("1").alias("digits"), F.lit(0).cast("bigint").alias("power"))

    def verdict(sides: Column) -> Column:
        """From both sides as arrays of a parsed number and, if there is one, its parsed denominator."""
        def crossed(fractions: Column) -> Column:
            (a, b), (c, d) = ((fractions[i]["top"], fractions[i]["bottom"]) for i in (0, 1))
            products = F.transform(
                F.array(F.struct(a.alias("x"), d.alias("y")), F.struct(c.alias("x"), b.alias("y"))), lambda p: _crossed(p["x"], p["y"])
            )
            zero = (a["digits"] == "") & (c["digits"] == "")
            signs = (a["negative"] != b["negative"]) == (c["negative"] != d["negative"])
            return (b["digits"] != "") & (d["digits"] != "") & (zero | signs & let(products, lambda p: p[0] == p[1]))

        plain = (F.size(sides[0]) == 1) & (F.size(sides[1]) == 1)
        fractions = F.transform(sides, lambda s: F.struct(s[0].alias("top"), F.coalesce(F.get(s, F.lit(1)), one).alias("bottom")))
        return F.when(plain, sides[0] == sides[1]).otherwise(let(fractions, crossed))

    def both(pattern: str) -> Column:
        return F.regexp_like(left, F.lit(pattern)) & F.regexp_like(right, F.lit(pattern))

    parsed = let(F.transform(F.array(left, right), lambda side: F.transform(F.split(side, "/"), _parsed)), verdict)
    return F.coalesce(F.when(both(_SHORT_FRACTION), _short_equal(left, right)).when(both(FRACTION), parsed), F.lit(False))


def contains_answer(prediction: Column, target: Column) -> Column:
    """True if the cleaned target occurs in the cleaned prediction and touches no further digit.

    The plain substring test comes first: it is cheap and settles most rows
    before a pattern has to be compiled for the row.
    """
    quoted = F.replace(target, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit("(?U)(?<!\\d)\\Q"), quoted, F.lit("\\E(?!\\d)"))
    found = F.when(F.contains(prediction, target), F.regexp_like(prediction, pattern)).otherwise(F.lit(False))
    return F.coalesce(found, F.lit(False))
