"""Column expressions on pixels: a pixel is four DOUBLE columns r, g, b, a."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b", "a")
# Luma weights of the separate consumers (compositing and adjustments, Rec. 601, Rec. 709).
LUMA_ADJUST = (0.3, 0.59, 0.11)
LUMA_601 = (0.299, 0.587, 0.114)
LUMA_709 = (0.2126, 0.7152, 0.0722)


class Px(NamedTuple):
    """One pixel's channels as columns."""

    r: Column
    g: Column
    b: Column
    a: Column

    @classmethod
    def of(cls, prefix: str = "") -> Px:
        return cls(*(F.col(prefix + c) for c in CHANNELS))

    @property
    def rgb(self) -> tuple[Column, Column, Column]:
        return self.r, self.g, self.b

    def each(self, f) -> Px:
        """f on all four channels."""
        return Px(*(f(c) for c in self))

    def color(self, f) -> Px:
        """f on r, g, b; alpha stays."""
        return Px(*(f(c) for c in self.rgb), self.a)

    def zip(self, other: Px, f) -> Px:
        return Px(*(f(x, y) for x, y in zip(self, other, strict=True)))

    def select(self, df: DataFrame, *keys: str) -> DataFrame:
        return df.select(*keys, *(F.coalesce(c, F.lit(0.0)).alias(n) for n, c in zip(CHANNELS, self, strict=True)))


def num(v: float) -> Column:
    return F.lit(float(v))


def mix(a, b, t) -> Column:
    return a + (b - a) * t


def clamp(v: Column, lo=0.0, hi=1.0) -> Column:
    return F.least(F.greatest(v, lo if isinstance(lo, Column) else num(lo)), hi if isinstance(hi, Column) else num(hi))


def rounded(v: Column, digits: int = 6) -> Column:
    """To so many decimals as SQL rounds doubles: scaled, then halves away from zero. ``F.round`` goes by a double's shortest decimals instead,
    so that what is a half when scaled may fall on the other side. Without negative zeros."""
    scaled = F.abs(v * 10.0**digits)
    near = F.rint(scaled)  # halves to even
    whole = F.when(scaled - near == 0.5, near + 1).otherwise(near)
    return F.when(v < 0, -whole).otherwise(whole) / 10.0**digits + 0.0


def ratio(a: Column, b: Column, otherwise=0.0) -> Column:
    """a / b, or ``otherwise`` where b is 0 (a plain division raises there)."""
    return F.when(b == 0, otherwise).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def smoothstep(lo: float, hi: float, x: Column) -> Column:
    t = clamp((x - lo) / (hi - lo)) if hi != lo else F.when(x < lo, 0.0).otherwise(1.0)
    return t * t * (3 - 2 * t)


def luma(rgb, weights=LUMA_ADJUST) -> Column:
    return rgb[0] * weights[0] + rgb[1] * weights[1] + rgb[2] * weights[2]


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def unpremultiply(p: Px) -> Px:
    return p.each(lambda c: ratio(c, p.a))._replace(a=p.a)


def premultiply(p: Px) -> Px:
    return p.color(lambda c: c * p.a)


def straight(p: Px, f) -> Px:
    """f on the unassociated colour, associated again; alpha stays."""
    u = unpremultiply(p)
    return Px(*(c * p.a for c in f(u.rgb)), p.a)


def let(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f uses it: nested hashes would grow without bound otherwise."""
    return F.get(F.transform(F.array(value), f), 0)


# Multiplier, increment and output multiplier of the published 32-bit permuted congruential hash.
PCG = (747796405, 2891336453, 277803737)


def pcg(x: Column) -> Column:
    """The hash of a BIGINT below 2**32, in BIGINT."""

    def word(state):
        shifted = F.call_function("shiftright", state, (F.shiftright(state, 28) + 4).cast("int")).bitwiseXOR(state)
        return let(_times(shifted, PCG[2], 0), lambda w: F.shiftright(w, 22).bitwiseXOR(w))

    return let(_times(x, PCG[0], PCG[1]), word)


def pcg_of(v: int) -> int:
    """The same for a number known when the plan is built."""
    state = (v * PCG[0] + PCG[1]) & 0xFFFFFFFF
    word = (((state >> ((state >> 28) + 4)) ^ state) * PCG[2]) & 0xFFFFFFFF
    return (word >> 22) ^ word


def _times(x: Column, factor: int, plus: int) -> Column:
    """x * factor + plus modulo 2**32: below 2**62 for x below 2**32, so a BIGINT holds it."""
    return (x * F.lit(factor).cast("bigint") + F.lit(plus).cast("bigint")).bitwiseAND(0xFFFFFFFF)


def hash01(x: Column, y: Column, seed: int) -> Column:
    """Noise in [0, 1) of a place and a seed."""
    wrap = lambda v: v.cast("bigint").bitwiseAND(0xFFFFFFFF)
    inner = pcg(wrap(y).bitwiseXOR(F.lit(pcg_of(seed & 0xFFFFFFFF)).cast("bigint")))
    return F.shiftright(pcg(wrap(x).bitwiseXOR(inner)), 8).cast("double") * (2.0**-24)


def quantize_f16(v: Column) -> Column:
    """The nearest half-precision value, for pipelines that store halves between steps."""
    size = F.abs(v)
    exponent = F.greatest(F.floor(F.log2(F.when(size == 0, 1.0).otherwise(size))), F.lit(-14)).cast("double")
    step = F.pow(num(2), exponent - 10)
    return F.when(size == 0, 0.0).otherwise(F.rint(v / step) * step)
