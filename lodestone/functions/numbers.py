"""Number functions over columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def parity(n: Column) -> Column:
    """``pmod``, so negative odd numbers are odd."""
    return F.when(F.pmod(n, F.lit(2)) == 0, "even").otherwise("odd")


def scaled_up(x: Column) -> Column:
    """(9 / 5) * (x - 32)."""
    return (x - 32) * 9 / 5


def scaled_down(x: Column) -> Column:
    """(x - 32) * (5 / 9): Fahrenheit to Celsius."""
    return (x - 32) * 5 / 9


def binary_digits(n: Column) -> Column:
    """Least significant first; none for n <= 0."""
    return F.when(n > 0, F.split(F.reverse(F.bin(n)), "")).otherwise(F.array().cast("array<string>"))


def decimal_digits(n: Column) -> Column:
    """In reading order; none for n <= 0."""
    return F.when(n > 0, F.split(n.cast("string"), "")).otherwise(F.array().cast("array<string>"))


#: Bases that decide primality by strong tests alone, below 3,215,031,751 and below 2**64.
FEW_BASES, BASES = (2, 3, 5, 7), (2, 325, 9375, 28178, 450775, 9780504, 1795265022)
SMALL_PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
#: Squares up to here fit a long.
ROOT = 3_037_000_499


def power_modulo(base: Column, bits: Column, n: Column, kind: str) -> Column:
    """base to the number with these binary digits (highest first), modulo n. ``kind`` is a type that holds n * n."""
    bound = n.cast(kind)
    times = lambda x, y: ((x * y) % bound).cast(kind)
    return F.aggregate(bits, F.lit(1).cast(kind), lambda r, bit: F.when(bit == "1", times(times(r, r), base)).otherwise(times(r, r)))


def _strong(n: Column, bases: tuple[int, ...], kind: str) -> Column:
    """Whether the odd n passes the strong test of every base; the first that fails ends it."""
    even = n - 1
    halvings = F.bit_count(even.bitwiseAND(-even) - 1)
    bits = F.split(F.bin(F.call_function("shiftright", even, halvings)), "")
    last = even.cast(kind)

    def passes(base):
        squared = F.aggregate(
            F.sequence(F.lit(1), halvings),
            F.struct(power_modulo(base, bits, n, kind).alias("x"), F.lit(False).alias("met"), F.lit(True).alias("first")),
            lambda s, _: F.struct(((s["x"] * s["x"]) % n.cast(kind)).cast(kind).alias("x"), (s["met"] | (s["x"] == last) | (s["first"] & (s["x"] == 1))).alias("met"), F.lit(False).alias("first")),
        )
        return squared["met"]

    return F.forall(F.array(*[F.lit(b).cast(kind) for b in bases]), passes)


def is_prime(n: Column) -> Column:
    """Of any long, without error: small divisors first, then strong tests to fixed bases (Miller and Rabin), about 128 products a base. Products
    are longs up to 3,037,000,499, decimals of 38 digits above. 1 and below are not prime."""
    n = n.cast("long")
    divided = F.lit(False)
    for p in SMALL_PRIMES:
        divided = divided | (n % p == 0)
    strong = F.when(n <= ROOT, _strong(n, FEW_BASES, "long")).otherwise(_strong(n, BASES, "decimal(38,0)"))
    return F.when(n < 2, False).when(n.isin(*SMALL_PRIMES), True).when(divided, False).when(n < 41 * 41, True).when(n.isNotNull(), strong)


def small_factorial(n: Column) -> Column:
    """Exact up to 20; null above."""
    return F.factorial(n)


#: A limb's size; a product of a limb and a factor up to MOST_FACTORIAL, and a carry, fit a long.
LIMB_DIGITS, MOST_FACTORIAL = 15, 9000


def times_small(limbs: Column, factor: Column) -> Column:
    """A number in limbs, lowest first, times one of at most ``MOST_FACTORIAL``: one fold that hands the carry on."""
    unit = F.lit(10**LIMB_DIGITS)

    def step(s, limb):
        product = limb * factor + s["carry"]
        return F.struct(F.call_function("div", product, unit).alias("carry"), F.array_append(s["out"], product % unit).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(limbs, start, step, lambda s: F.when(s["carry"] > 0, F.array_append(s["out"], s["carry"])).otherwise(s["out"]))


def limbs_text(limbs: Column) -> Column:
    """The decimal digits of a number in limbs."""
    high = F.element_at(limbs, -1).cast("string")
    low = F.transform(F.slice(F.reverse(limbs), F.lit(2), F.size(limbs)), lambda x: F.lpad(x.cast("string"), LIMB_DIGITS, "0"))
    return F.concat(high, F.array_join(low, ""))


def factorial_text(n: Column) -> Column:
    """n! as decimal text, exact up to n = 9,000; null below 0 and above. Work grows with the digits of the result times n."""
    factors = F.when(n >= 2, F.sequence(F.lit(2).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.when((n >= 0) & (n <= MOST_FACTORIAL), limbs_text(F.aggregate(factors, F.array(F.lit(1).cast("long")), times_small)))


def fibonacci_terms(n: Column) -> Column:
    """n + 1 terms from 1, 1; exact to n = 90."""
    start = F.array(F.lit(1).cast("long"), F.lit(1).cast("long"))
    more = F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    grown = F.aggregate(more, start, lambda a, _: F.array_append(a, F.element_at(a, -1) + F.element_at(a, -2)))
    return F.slice(grown, F.lit(1), n + 1)


def gaussian(x: Column, mean: float = 0.0, deviation: float = 15.0) -> Column:
    return F.exp(-F.pow(x - mean, F.lit(2.0)) / (2 * deviation * deviation)) / (deviation * math.sqrt(2 * math.pi))


def price(amount: Column, tax: float = 0.07, discount: float = 0.0) -> Column:
    return amount + amount * tax - discount


def linspace(a: Column, b: Column, n: int) -> Column:
    """n evenly spaced numbers from a to b, both ends included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: a + k.cast("double") * ((b - a) / max(n - 1, 1)))


def polynomial(x: Column, *coefficients: float) -> Column:
    """Highest power first, by Horner's rule."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + float(c)
    return out
