"""Pointwise kernels: each is a function of one or two pixels and parameters that returns a pixel expression.

Arithmetic, predicates, logic, casts, channel plumbing, compositing and colour adjustments. They fuse
into one projection; the two-input ones read a left join on the coordinates, where a missing
second pixel is transparent black.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.pixel import LUMA_709, LUMA_ADJUST, Px, clamp, flag, let, luma, mix, num, premultiply, ratio, smoothstep, straight, unpremultiply
from gridspark.plans.registry import kernel

# -- arithmetic ---------------------------------------------------------------------------------


@kernel("math.linear", gain=1.0, bias=0.0)
def linear(a, gain, bias):
    return a.each(lambda c: c * gain + bias)


@kernel("math.invert")
def invert(a):
    return a.each(lambda c: 1 - c)


def _pair(name, f):
    kernel(name, inputs=2)(lambda a, b: a.zip(b, f))


def _one(name, f, **params):
    kernel(name, **params)(lambda a, **p: a.each(lambda c: f(c, **p)))


_pair("math.add", lambda x, y: x + y)
_pair("math.sub", lambda x, y: x - y)
_pair("math.mul", lambda x, y: x * y)
_pair("math.div", lambda x, y: ratio(x, y, F.when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(float("nan"))))
_pair("math.min", F.least)
_pair("math.max", F.greatest)
_one("math.add_const", lambda c, v: c + v, v=0.0)
_one("math.mul_const", lambda c, v: c * v, v=1.0)
_one("math.abs", lambda c: F.abs(c))
_one("math.sign", lambda c: F.when(F.isnan(c), 0.0).when(c > 0, 1.0).when(c < 0, -1.0).otherwise(0.0))
_one("math.neg", lambda c: -c)
_one("math.clamp", lambda c, lo, hi: clamp(c, lo, hi), lo=0.0, hi=1.0)
_one("math.min_const", lambda c, v: F.least(c, num(v)), v=1.0)
_one("math.max_const", lambda c, v: F.greatest(c, num(v)), v=0.0)

# -- predicates and logic -----------------------------------------------------------------------
# Comparisons with NaN are false (Spark would order NaN above all numbers).


def _finite(x, y, c):
    return flag(~F.isnan(x) & ~F.isnan(y) & c)


_pair("rel.eq", lambda x, y: _finite(x, y, x == y))
_pair("rel.ne", lambda x, y: flag(F.isnan(x) | F.isnan(y) | (x != y)))
_pair("rel.lt", lambda x, y: _finite(x, y, x < y))
_pair("rel.le", lambda x, y: _finite(x, y, x <= y))
_pair("rel.gt", lambda x, y: _finite(x, y, x > y))
_pair("rel.ge", lambda x, y: _finite(x, y, x >= y))


def _truthy(c):
    return ~F.isnan(c) & (c > 0.5)


_pair("bool.and", lambda x, y: flag(_truthy(x) & _truthy(y)))
_pair("bool.or", lambda x, y: flag(_truthy(x) | _truthy(y)))
_pair("bool.xor", lambda x, y: flag(_truthy(x) != _truthy(y)))
_one("bool.not", lambda c: flag(~_truthy(c)))

# -- casts and channels -------------------------------------------------------------------------


kernel("cast.premultiply")(premultiply)


@kernel("cast.unpremultiply")
def _unpremultiply(a):
    return unpremultiply(a)


@kernel("band.copy")
def copy(a):
    return a


@kernel("band.extract", channel=0)
def extract(a, channel):
    c = a[channel]
    return Px(c, c, c, num(1))


@kernel("band.set_alpha", alpha=1.0)
def set_alpha(a, alpha):
    return a._replace(a=num(alpha))


@kernel("band.broadcast_alpha")
def broadcast_alpha(a):
    return Px(a.a, a.a, a.a, a.a)


# -- compositing --------------------------------------------------------------------------------


def source_over(backdrop: Px, source: Px, blend, opacity) -> Px:
    """W3C source-over with a blend function of the unassociated colours; ``backdrop`` and ``source`` are premultiplied."""
    cb, cs, ab, alpha = unpremultiply(backdrop), unpremultiply(source), backdrop.a, source.a * opacity
    mixed = blend(cb.rgb, cs.rgb)
    rgb = (alpha * (1 - ab) * s + alpha * ab * m + (1 - alpha) * ab * b for s, m, b in zip(cs.rgb, mixed, cb.rgb, strict=True))
    return Px(*rgb, alpha + ab * (1 - alpha))


BLENDS: dict[str, object] = {}


def _blend(name, f):
    BLENDS[name] = f
    kernel(f"compose.{name}", inputs=2, opacity=1.0)(lambda a, b, opacity: source_over(a, b, f, opacity))


def _per_channel(name, f):
    _blend(name, lambda cb, cs: tuple(f(b, s) for b, s in zip(cb, cs, strict=True)))


def _screen(b, s):
    return b + s - b * s


def _hard(b, s):
    return F.when(s <= 0.5, b * (2 * s)).otherwise(_screen(b, 2 * s - 1))


def _dodge(b, s):
    return F.when(b == 0, 0.0).when(s >= 1, 1.0).otherwise(F.least(num(1), ratio(b, 1 - s, 1.0)))


def _burn(b, s):
    return F.when(b >= 1, 1.0).when(s <= 0, 0.0).otherwise(1 - F.least(num(1), ratio(1 - b, s, 1.0)))


def _soft(b, s):
    d = F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(F.greatest(b, num(0))))
    return F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (d - b))


_per_channel("normal", lambda b, s: s)
_per_channel("multiply", lambda b, s: b * s)
_per_channel("screen", _screen)
_per_channel("overlay", lambda b, s: _hard(s, b))
_per_channel("darken", F.least)
_per_channel("lighten", F.greatest)
_per_channel("color_dodge", _dodge)
_per_channel("color_burn", _burn)
_per_channel("hard_light", _hard)
_per_channel("soft_light", _soft)
_per_channel("difference", lambda b, s: F.abs(b - s))
_per_channel("exclusion", lambda b, s: b + s - 2 * b * s)
_per_channel("linear_burn", lambda b, s: F.greatest(b + s - 1, num(0)))
_per_channel("linear_dodge", lambda b, s: F.least(b + s, num(1)))
_per_channel("vivid_light", lambda b, s: F.when(s <= 0.5, _burn(b, 2 * s)).otherwise(_dodge(b, 2 * s - 1)))
_per_channel("linear_light", lambda b, s: clamp(b + 2 * s - 1))
_per_channel("pin_light", lambda b, s: F.when(s <= 0.5, F.least(b, 2 * s)).otherwise(F.greatest(b, 2 * s - 1)))
_per_channel("hard_mix", lambda b, s: F.when(b + s < 1, 0.0).otherwise(1.0))
_per_channel("subtract", lambda b, s: F.greatest(b - s, num(0)))
_per_channel("divide", lambda b, s: F.when(s == 0, 1.0).otherwise(F.least(ratio(b, s, 1.0), num(1))))


# The blends below look at all three channels at once, time and again; each step's triple is an array
# that is worked out once.


def _three(v: Column) -> list[Column]:
    return [F.get(v, i) for i in range(3)]


def clip_color(triple: Column) -> Column:
    """Into 0..1 at equal luma."""

    def clipped(t):
        c = _three(t)

        def scaled(k):
            low, high, light = _three(k)
            up = [F.when(low < 0, light + ratio((x - light) * light, light - low)).otherwise(x) for x in c]
            return F.array(*(F.when(high > 1, light + ratio((x - light) * (1 - light), high - light)).otherwise(x) for x in up))

        return let(F.array(F.least(*c), F.greatest(*c), luma(c)), scaled)

    return let(triple, clipped)


def set_luma(triple: Column, light: Column) -> Column:
    return clip_color(let(triple, lambda t: let(light - luma(_three(t)), lambda d: F.array(*(x + d for x in _three(t))))))


def saturation_of(c):
    return F.greatest(*c) - F.least(*c)


def set_saturation(c, s) -> Column:
    low, high = F.least(*c), F.greatest(*c)
    return F.array(*(F.when(high > low, ratio((x - low) * s, high - low)).otherwise(0.0) for x in c))


def _whole(name, f):
    def blend(cb, cs):
        return _three(let(F.array(*cb, *cs), lambda v: f([F.get(v, i) for i in range(3)], [F.get(v, i) for i in range(3, 6)])))

    _blend(name, blend)


def _pick(first, cb, cs):
    return tuple(F.when(first, b).otherwise(s) for b, s in zip(cb, cs, strict=True))


_whole("hue", lambda cb, cs: set_luma(set_saturation(cs, saturation_of(cb)), luma(cb)))
_whole("saturation", lambda cb, cs: set_luma(set_saturation(cb, saturation_of(cs)), luma(cb)))
_whole("color", lambda cb, cs: set_luma(F.array(*cs), luma(cb)))
_whole("luminosity", lambda cb, cs: set_luma(F.array(*cb), luma(cs)))
_blend("darker_color", lambda cb, cs: _pick(luma(cb) <= luma(cs), cb, cs))
_blend("lighter_color", lambda cb, cs: _pick(luma(cb) >= luma(cs), cb, cs))

# -- adjustments --------------------------------------------------------------------------------


@kernel("adjust.exposure", ev=0.0)
def exposure(a, ev):
    return a.color(lambda c: c * 2.0**ev)


@kernel("adjust.brightness_contrast", brightness=0.0, contrast=1.0)
def brightness_contrast(a, brightness, contrast):
    return straight(a, lambda c: [(x - 0.5) * contrast + 0.5 + brightness for x in c])


def level(x, in_black, in_white, gamma, out_black=0.0, out_white=1.0):
    t = clamp((x - in_black) / (in_white - in_black)) if in_white != in_black else flag(x > in_black)
    return out_black + F.pow(t, num(1 / gamma)) * (out_white - out_black)


@kernel("adjust.levels", in_black=0.0, in_white=1.0, gamma=1.0, out_black=0.0, out_white=1.0)
def levels(a, **p):
    return straight(a, lambda c: [level(x, **p) for x in c])


@kernel("adjust.levels_rgb", r=(0.0, 1.0, 1.0), g=(0.0, 1.0, 1.0), b=(0.0, 1.0, 1.0))
def levels_rgb(a, r, g, b):
    return straight(a, lambda c: [level(x, *p) for x, p in zip(c, (r, g, b), strict=True)])


@kernel("adjust.saturation", sat=1.0)
def saturation(a, sat):
    return straight(a, lambda c: [mix(luma(c), x, sat) for x in c])


def hue_matrix(degrees: float) -> list[list[float]]:
    """The luminance-preserving rotation of the SVG filter specification."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    w = (0.213, 0.715, 0.072)
    turn = ((-0.213, -0.715, 0.928), (0.143, 0.140, -0.283), (-0.787, 0.715, 0.072))
    return [[w[j] + c * ((i == j) - w[j]) + s * turn[i][j] for j in range(3)] for i in range(3)]


@kernel("adjust.hue_rotate", degrees=0.0)
def hue_rotate(a, degrees):
    return straight(a, lambda c: [sum((x * k for x, k in zip(c[1:], row[1:], strict=True)), c[0] * row[0]) for row in hue_matrix(degrees)])


@kernel("adjust.invert_rgb")
def invert_rgb(a):
    return straight(a, lambda c: [1 - x for x in c])


@kernel("adjust.white_balance", temp=0.0, tint=0.0)
def white_balance(a, temp, tint):
    return straight(a, lambda c: [c[0] * (1 + temp), c[1] * (1 + tint), c[2] * (1 - temp)])


@kernel("adjust.vibrance", vibrance=0.0, saturation=0.0)
def vibrance(a, vibrance, saturation):
    def f(c):
        k = 1 + saturation + vibrance * (1 - (F.greatest(*c) - F.least(*c)))
        return [mix(luma(c), x, k) for x in c]

    return straight(a, f)


def restore_luma(before, after):
    d = luma(before) - luma(after)
    return [clamp(x + d) for x in after]


@kernel("adjust.color_balance", shadows=(0.0, 0.0, 0.0), mids=(0.0, 0.0, 0.0), highlights=(0.0, 0.0, 0.0))
def color_balance(a, shadows, mids, highlights):
    def f(c):
        light = luma(c)
        dark, bright = 1 - smoothstep(0.0, 0.5, light), smoothstep(0.5, 1.0, light)
        middle = 1 - dark - bright
        return restore_luma(c, [x + s * dark + m * middle + h * bright for x, s, m, h in zip(c, shadows, mids, highlights, strict=True)])

    return straight(a, f)


@kernel("adjust.black_white", reds=0.4, yellows=0.6, greens=0.4, cyans=0.6, blues=0.2, magentas=0.8)
def black_white(a, reds, yellows, greens, cyans, blues, magentas):
    def f(c):
        r, g, b = c
        low, high = F.least(*c), F.greatest(*c)
        mid = r + g + b - low - high
        gray = lambda one, two: low + (mid - low) * two + (high - mid) * one
        v = F.when((r >= g) & (g >= b), gray(reds, yellows)).when((g >= r) & (r >= b), gray(greens, yellows)).when((g >= b) & (b >= r), gray(greens, cyans))
        v = v.when((b >= g) & (g >= r), gray(blues, cyans)).when((b >= r) & (r >= g), gray(blues, magentas)).otherwise(gray(reds, magentas))
        return [v, v, v]

    return straight(a, f)


@kernel("adjust.posterize", levels=4.0)
def posterize(a, levels):
    n = max(levels, 2.0)
    return straight(a, lambda c: [F.least(F.floor(clamp(x) * n).cast("double") / (n - 1), num(1)) for x in c])


@kernel("adjust.threshold", threshold=0.5)
def threshold(a, threshold):
    v = F.when(luma(a.rgb) >= a.a * threshold, a.a).otherwise(0.0)
    return Px(v, v, v, a.a)


@kernel("adjust.photo_filter", color=(1.0, 0.6, 0.2), density=0.25, preserve=1)
def photo_filter(a, color, density, preserve):
    def f(c):
        out = [mix(x, x * k, density) for x, k in zip(c, color, strict=True)]
        return restore_luma(c, out) if preserve else out

    return straight(a, f)


def _between(table: Column, position: Column, last: int) -> Column:
    """The table's value at a fractional place."""
    at = F.floor(position).cast("int")
    return mix(F.get(table, at), F.get(table, F.least(at + 1, F.lit(last))), position - at)


def _tables(rows) -> list[Column]:
    return [F.lit([float(v) for v in row]) for row in rows]


@kernel("adjust.lut1d", lut=tuple(i / 255 for i in range(256)))
def lut1d(a, lut):
    table = F.lit([float(v) for v in lut])
    return straight(a, lambda c: [_between(table, clamp(x) * 255, 255) for x in c])


@kernel("adjust.gradient_map", ramp=None)
def gradient_map(a, ramp):
    ramp = ramp or [(i / 255,) * 3 for i in range(256)]
    tables = _tables(zip(*ramp, strict=True))
    return straight(a, lambda c: [_between(t, clamp(luma(c, LUMA_709)) * 255, 255) for t in tables])


@kernel("adjust.lut3d", cube=None, size=9)
def lut3d(a, cube, size):
    """cube: size**3 triples, red fastest."""
    cube = cube or [(r / (size - 1), g / (size - 1), b / (size - 1)) for b in range(size) for g in range(size) for r in range(size)]
    tables = _tables(zip(*cube, strict=True))

    def f(c):
        place = [clamp(x) * (size - 1) for x in c]
        low = [F.least(F.floor(p), F.lit(size - 2)).cast("int") for p in place]
        part = [p - q for p, q in zip(place, low, strict=True)]
        out = []
        for t in tables:
            total = num(0)
            for corner in range(8):
                bits = [corner >> k & 1 for k in range(3)]
                at = ((low[2] + bits[2]) * size + low[1] + bits[1]) * size + low[0] + bits[0]
                weight = num(1)
                for bit, w in zip(bits, part, strict=True):
                    weight = weight * (w if bit else 1 - w)
                total = total + F.get(t, at) * weight
            out.append(total)
        return out

    return straight(a, f)


@kernel("adjust.channel_mixer", red=(1.0, 0.0, 0.0, 0.0), green=(0.0, 1.0, 0.0, 0.0), blue=(0.0, 0.0, 1.0, 0.0))
def channel_mixer(a, red, green, blue):
    return straight(a, lambda c: [c[0] * k[0] + c[1] * k[1] + c[2] * k[2] + k[3] for k in (red, green, blue)])


@kernel("adjust.selective_color", range=0, cyan=0.0, magenta=0.0, yellow=0.0, black=0.0, absolute=0)
def selective_color(a, range, cyan, magenta, yellow, black, absolute):
    """range: 0..8 = reds, yellows, greens, cyans, blues, magentas, whites, neutrals, blacks."""

    def f(c):
        r, g, b = c
        low, high = F.least(*c), F.greatest(*c)
        mid = r + g + b - low - high
        own = [(r, high), (b, low), (g, high), (r, low), (b, high), (g, low)]
        if range < 6:
            channel, extreme = own[range]
            amount = F.when(channel == extreme, (high - mid) if range % 2 == 0 else (mid - low)).otherwise(0.0)
        elif range == 6:
            amount = clamp((low - 0.5) * 2)
        elif range == 7:
            amount = clamp(1 - (F.abs(high - 0.5) + F.abs(low - 0.5)))
        else:
            amount = clamp((0.5 - high) * 2)
        out = []
        for x, ink in zip(c, (cyan, magenta, yellow), strict=True):
            shift = -ink - black * (1 + ink) if absolute else (-ink - black * (1 + ink)) * (1 - x)
            out.append(clamp(x + clamp(shift if isinstance(shift, Column) else num(shift), -x, 1 - x) * amount))
        return out

    return straight(a, f)


LUMA = LUMA_ADJUST
