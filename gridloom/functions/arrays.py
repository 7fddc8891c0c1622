"""Array and string exercises as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_products(a: Column) -> Column:
    """Product of the elements before each one."""
    out = F.aggregate(a, F.struct(F.array().cast("array<double>").alias("o"), F.lit(1.0).alias("p")), lambda s, x: F.struct(F.concat(s["o"], F.array(s["p"])).alias("o"), (s["p"] * x).alias("p")))
    return out["o"]


def product_except_self(a: Column) -> Column:
    """Product of all other elements, without division."""
    return F.zip_with(prefix_products(a), F.reverse(prefix_products(F.reverse(a))), lambda x, y: x * y)


def max_profit(a: Column) -> Column:
    """Best single trade: largest later minus earlier value, 0 at least."""
    s = F.struct(F.lit(0.0).alias("best"), F.get(a, F.lit(0)).cast("double").alias("low"))
    return F.aggregate(a, s, lambda s, x: F.struct(F.greatest(s["best"], x - s["low"]).alias("best"), F.least(s["low"], x.cast("double")).alias("low")))["best"]


def sum_of_rises(a: Column) -> Column:
    s = F.struct(F.lit(0.0).alias("t"), F.get(a, F.lit(0)).cast("double").alias("p"))
    return F.aggregate(a, s, lambda s, x: F.struct((s["t"] + F.greatest(x - s["p"], F.lit(0.0))).alias("t"), x.cast("double").alias("p")))["t"]


def can_reach_end(a: Column) -> Column:
    """Jump game: whether the last index is reachable with jumps of up to a[i]."""
    at = F.transform(a, lambda x, i: F.struct(x.cast("int").alias("v"), i.alias("i")))
    reach = F.aggregate(at, F.lit(0), lambda r, x: F.when(x["i"] > r, r).otherwise(F.greatest(r, x["i"] + x["v"])))
    return reach >= F.size(a) - 1


def stairs(n: Column) -> Column:
    """Ways to climb n stairs by ones and twos."""
    start = F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b")))["a"]


def balanced(text: Column) -> Column:
    """Whether (), [] and {} are balanced; other characters don't count."""
    only = F.regexp_replace(text, r"[^()\[\]{}]", "")
    chars = F.filter(F.split(only, ""), lambda c: c != "")
    opened = lambda c: F.translate(c, ")]}", "([{")
    step = lambda s, c: F.when(c.isin("(", "[", "{"), F.concat(s, c)).when(F.right(s, F.lit(1)) == opened(c), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(F.lit("!"))
    return F.aggregate(chars, F.lit(""), lambda s, c: F.when(s.startswith("!"), s).otherwise(step(s, c))) == ""


def is_subsequence(word: str, text: Column) -> Column:
    """Whether word's characters appear in order."""
    left = F.aggregate(F.split(text, ""), F.lit(word), lambda s, c: F.when((s != "") & (c == F.left(s, F.lit(1))), F.substring(s, F.lit(2), F.length(s))).otherwise(s))
    return left == ""


def triangle_min_path(rows: Column) -> Column:
    """Smallest path sum from the top of a triangle (array of arrays) to its bottom."""
    last = F.element_at(rows, -1)
    above = F.reverse(F.slice(rows, F.lit(1), F.size(rows) - 1))
    return F.aggregate(above, last, lambda s, r: F.zip_with(r, F.slice(F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.least(a, F.coalesce(b, a))), F.lit(1), F.size(r)), lambda a, b: a + b))[0]


def longest_unique_run(text: Column) -> Column:
    """Length of the longest substring without a repeated character."""
    s = F.struct(F.lit("").alias("run"), F.lit(0).alias("best"))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    tail = lambda run, c: F.concat(F.when(run.contains(c), F.call_function("substring_index", run, c, F.lit(-1))).otherwise(run), c)
    out = F.aggregate(chars, s, lambda s, c: F.struct(tail(s["run"], c).alias("run"), F.greatest(s["best"], F.length(tail(s["run"], c))).alias("best")))
    return out["best"]


#: Decimal digits of a limb: products of two fit a long millions of times over.
LIMB = 6


def _limbs(text: Column) -> Column:
    """The limbs of a string of digits, lowest first."""
    n = F.ceil(F.length(text) / LIMB).cast("int")
    padded = F.lpad(text, n * LIMB, F.lit("0"))
    return F.transform(F.sequence(n - 1, F.lit(0)), lambda i: F.substring(padded, i * LIMB + 1, F.lit(LIMB)).cast("bigint"))


def _digits(sums: Column) -> Column:
    """The number whose limbs, lowest first, are sums that may be too large for one."""
    none = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("over"))
    done = F.aggregate(sums, none, lambda s, x: F.struct(F.concat(F.array((s["over"] + x) % 10**LIMB), s["out"]).alias("out"), F.floor((s["over"] + x) / F.lit(10**LIMB)).cast("bigint").alias("over")))
    text = lambda d: F.concat(d["over"].cast("string"), F.array_join(F.transform(d["out"], lambda x: F.lpad(x.cast("string"), LIMB, "0")), ""))
    return F.regexp_replace(F.transform(F.array(done), text)[0], "^0+(?=.)", "")


def _if_digits(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.rlike(r"\A[0-9]+\z") & b.rlike(r"\A[0-9]+\z"), value)


def long_product(a: Column, b: Column) -> Column:
    """Product of two strings of digits of any length, without leading zeros; null if either isn't one."""

    def multiplied(p: Column) -> Column:
        x, y = p["x"], p["y"]
        places = F.sequence(F.lit(0), F.size(x) + F.size(y) - 2)
        at = lambda k: F.sequence(F.greatest(F.lit(0), k - F.size(y) + 1), F.least(k, F.size(x) - 1))
        return F.transform(places, lambda k: F.aggregate(at(k), F.lit(0).cast("bigint"), lambda s, i: s + F.get(x, i) * F.get(y, k - i)))

    sums = F.transform(F.array(F.struct(_limbs(a).alias("x"), _limbs(b).alias("y"))), multiplied)[0]
    return _if_digits(a, b, _digits(sums))


def long_sum(a: Column, b: Column) -> Column:
    """Sum of two strings of digits of any length, without leading zeros; null if either isn't one."""
    zero = F.lit(0).cast("bigint")
    return _if_digits(a, b, _digits(F.zip_with(_limbs(a), _limbs(b), lambda x, y: F.coalesce(x, zero) + F.coalesce(y, zero))))
