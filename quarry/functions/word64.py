"""Arithmetic modulo 2**64 on long columns, in any session: nothing here can overflow, so ANSI mode does not object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import bound

LOW = 0xFFFFFFFF
#: Fixed values of the generators: multiplier and increment of the linear ones, steps of the shifting ones.
MMIX, MMIX_ADD = 6364136223846793005, 1442695040888963407
KNUTH, KNUTH_ADD = 2862933555777941757, 3037000493
GOLDEN = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
STAR = 0x2545F4914F6CDD1D
GENERATORS = ("xorshift64", "lcg_mmix", "lcg_knuth", "lcg_plus_1", "xorshift64_star", "splitmix64")


def signed(v: int) -> int:
    v &= (1 << 64) - 1
    return v - (1 << 64) if v >> 63 else v


def add(x: Column, y: Column) -> Column:
    low = x.bitwiseAND(F.lit(LOW)) + y.bitwiseAND(F.lit(LOW))
    high = F.shiftrightunsigned(x, 32) + F.shiftrightunsigned(y, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(LOW)))


def mul(x: Column, c: int | Column) -> Column:
    """x times c: four products of at most 48 bits."""

    def product(v: Column) -> Column:
        a, b = v["a"], v["b"]
        a_lo, a_hi = a.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(a, 32)
        b_0, b_1, b_hi = b.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(b, 16).bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(b, 32)

        def low32(p: Column, q_0: Column, q_1: Column) -> Column:
            return (p * q_0 + F.shiftleft((p * q_1).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(LOW))

        cross = low32(a_hi, b_0, b_1) + low32(a_lo, b_hi.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(b_hi, 16))
        return add(add(a_lo * b_0, F.shiftleft(a_lo * b_1, 16)), F.shiftleft(cross, 32))

    return bound(F.struct(x.alias("a"), (c if isinstance(c, Column) else F.lit(signed(c)).cast("long")).alias("b")), product)


def xor_shift(x: Column, n: int) -> Column:
    """x ^ x << n, or for negative n x ^ x >> -n."""
    return bound(x, lambda v: v.bitwiseXOR(F.shiftleft(v, n) if n > 0 else F.shiftrightunsigned(v, -n)))


def mix(z: Column) -> Column:
    """The finaliser of splitmix64 (F16)."""
    z = mul(xor_shift(z, -30), MIX_1)
    z = mul(xor_shift(z, -27), MIX_2)
    return xor_shift(z, -31)


def _unshift(z: Column, n: int) -> Column:
    return bound(z, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, n)).bitwiseXOR(F.shiftrightunsigned(v, 2 * n)))


def unmix(z: Column) -> Column:
    """The value of which mix gives z: odd multipliers have inverses modulo 2**64."""
    z = mul(_unshift(z, 31), pow(MIX_2, -1, 1 << 64))
    z = mul(_unshift(z, 27), pow(MIX_1, -1, 1 << 64))
    return _unshift(z, 30)


def step(generator: int, s: Column) -> Column:
    """The state after s."""
    if generator == 0:
        return xor_shift(xor_shift(xor_shift(s, 13), -7), 17)
    if generator == 4:
        return xor_shift(xor_shift(xor_shift(s, -12), 25), -27)
    if generator == 5:
        return add(s, F.lit(signed(GOLDEN)).cast("long"))
    m, a = ((MMIX, MMIX_ADD), (KNUTH, KNUTH_ADD), (MMIX, 1))[generator - 1]
    return add(mul(s, m), F.lit(signed(a)).cast("long"))


def emit(generator: int, s: Column) -> Column:
    """The word that state s puts out."""
    return mul(s, STAR) if generator == 4 else mix(s) if generator == 5 else s


def state(generator: int, word: Column) -> Column:
    """The state that puts out word."""
    return mul(word, pow(STAR, -1, 1 << 64)) if generator == 4 else unmix(word) if generator == 5 else word


def lcg_at(seed: int, m: int, a: int, n: Column, bits: int = 48) -> Column:
    """The n-th state after seed of s -> m s + a: n's bits choose among the 1, 2, 4, ... step jumps."""
    jumps, k, c = [], m, a
    for bit in range(bits):
        used = F.shiftrightunsigned(n, bit).bitwiseAND(F.lit(1)) == 1
        jumps.append(F.when(used, F.struct(F.lit(signed(k)).cast("long").alias("k"), F.lit(signed(c)).cast("long").alias("c"))))
        k, c = k * k & (1 << 64) - 1, (k * c + c) & (1 << 64) - 1
    start = F.lit(signed(seed)).cast("long")
    chosen = F.array_compact(F.array(*jumps))
    return F.aggregate(chosen, start, lambda s, j: add(mul(s, j["k"]), j["c"]))
