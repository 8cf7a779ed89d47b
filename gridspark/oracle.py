"""DuckDB SQL for the registered queries, written from the formulas, not from the Spark plans."""

from __future__ import annotations

import math

PX = """px AS (SELECT t.x AS x, vec_id AS y, least(greatest(coalesce(embedding[t.x * 4 + 1], 0)::DOUBLE + 0.5, 0), 1) AS r, least(greatest(coalesce(embedding[t.x * 4 + 2], 0)::DOUBLE + 0.5, 0), 1) AS g,
 least(greatest(coalesce(embedding[t.x * 4 + 3], 0)::DOUBLE + 0.5, 0), 1) AS b, least(greatest(coalesce(embedding[t.x * 4 + 4], 0)::DOUBLE + 0.5, 0), 1) AS a FROM embeddings, range(16) t(x))"""
PAIR = """pair AS (SELECT p.x, p.y, p.r, p.g, p.b, p.a, q.r AS r2, q.g AS g2, q.b AS b2, q.a AS a2, CASE WHEN p.a = 0 THEN 0 ELSE p.r / p.a END AS br, CASE WHEN p.a = 0 THEN 0 ELSE p.g / p.a END AS bg,
 CASE WHEN p.a = 0 THEN 0 ELSE p.b / p.a END AS bb, CASE WHEN q.a = 0 THEN 0 ELSE q.r / q.a END AS sr, CASE WHEN q.a = 0 THEN 0 ELSE q.g / q.a END AS sg, CASE WHEN q.a = 0 THEN 0 ELSE q.b / q.a END AS sb
 FROM px p JOIN px q ON q.x = 15 - p.x AND q.y = p.y)"""
STRAIGHT = "u AS (SELECT x, y, a, CASE WHEN a = 0 THEN 0 ELSE r / a END AS r, CASE WHEN a = 0 THEN 0 ELSE g / a END AS g, CASE WHEN a = 0 THEN 0 ELSE b / a END AS b FROM px)"
SIZE = "size AS (SELECT max(x) AS w, max(y) AS h FROM px)"


def final(source: str, r: str, g: str, b: str, a: str, *ctes: str, where: str = "") -> str:
    cols = ", ".join(f"round(({e})::DOUBLE, 6) + 0.0 AS {c}" for c, e in zip("rgba", (r, g, b, a), strict=True))
    return f"WITH {', '.join((PX, *ctes))} SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, {cols} FROM {source}{where}"


def each(template: str) -> str:
    return final("px", *(template.replace("@", c) for c in "rgba"))


def both(template: str) -> str:
    return final("pair", *(template.replace("@2", c + "2").replace("@", c) for c in "rgba"), PAIR)


def clamp(e: str, lo="0", hi="1") -> str:
    return f"least(greatest({e}, {lo}), {hi})"


def straight(*rgb: str, extra: str = "") -> str:
    return final("u", *(f"({e}) * a" for e in rgb), "a", STRAIGHT, *([extra] if extra else []))


def straight_each(template: str) -> str:
    return straight(*(template.replace("@", c) for c in "rgb"))


def luma(r, g, b, w=(0.3, 0.59, 0.11)) -> str:
    return f"(({r}) * {w[0]} + ({g}) * {w[1]} + ({b}) * {w[2]})"


LUM, LUM709 = luma("r", "g", "b"), luma("r", "g", "b", (0.2126, 0.7152, 0.0722))


def flag(e: str) -> str:
    return f"CASE WHEN {e} THEN 1.0 ELSE 0.0 END"


# -- point kernels --------------------------------------------------------------------------------

POINT = {
    "math.linear": each("@ * 1.5 + -0.2"), "math.invert": each("1 - @"), "math.add": both("@ + @2"), "math.sub": both("@ - @2"), "math.mul": both("@ * @2"),
    "math.div": both("CASE WHEN @2 = 0 THEN 0 ELSE @ / @2 END"), "math.add_const": each("@ + 0.25"), "math.mul_const": each("@ * 0.75"), "math.abs": each("abs(@ - 0.0)"),
    "math.sign": each("CASE WHEN @ > 0 THEN 1.0 WHEN @ < 0 THEN -1.0 ELSE 0.0 END"), "math.neg": each("-@"), "math.min": both("least(@, @2)"), "math.max": both("greatest(@, @2)"),
    "math.clamp": each(clamp("@", "0.4", "0.6")), "math.min_const": each("least(@, 0.5)"), "math.max_const": each("greatest(@, 0.5)"),
    "rel.eq": both(flag("@ = @2")), "rel.ne": both(flag("@ <> @2")), "rel.lt": both(flag("@ < @2")), "rel.le": both(flag("@ <= @2")), "rel.gt": both(flag("@ > @2")), "rel.ge": both(flag("@ >= @2")),
    "bool.and": both(flag("@ > 0.5 AND @2 > 0.5")), "bool.or": both(flag("@ > 0.5 OR @2 > 0.5")), "bool.xor": both(flag("(@ > 0.5) <> (@2 > 0.5)")), "bool.not": each(flag("NOT @ > 0.5")),
    "cast.premultiply": final("px", "r * a", "g * a", "b * a", "a"), "cast.unpremultiply": final("u", "r", "g", "b", "a", STRAIGHT),
    "band.copy": each("@"), "band.extract": final("px", "g", "g", "g", "1"), "band.set_alpha": final("px", "r", "g", "b", "0.5"), "band.broadcast_alpha": each("a"),
}

_SCREEN = "(({b}) + ({s}) - ({b}) * ({s}))"


def _screen(b, s):
    return _SCREEN.format(b=b, s=s)


def _hard(b, s):
    return f"(CASE WHEN {s} <= 0.5 THEN {b} * 2 * {s} ELSE {_screen(b, f'2 * {s} - 1')} END)"


def _dodge(b, s):
    return f"(CASE WHEN {b} = 0 THEN 0 WHEN {s} >= 1 THEN 1 ELSE least(1, {b} / (1 - ({s}))) END)"


def _burn(b, s):
    return f"(CASE WHEN {b} >= 1 THEN 1 WHEN {s} <= 0 THEN 0 ELSE 1 - least(1, (1 - {b}) / ({s})) END)"


CHANNEL_BLENDS = {
    "normal": lambda b, s: s, "multiply": lambda b, s: f"{b} * {s}", "screen": _screen, "overlay": lambda b, s: _hard(s, b), "darken": lambda b, s: f"least({b}, {s})", "lighten": lambda b, s: f"greatest({b}, {s})",
    "color_dodge": _dodge, "color_burn": _burn, "hard_light": _hard,
    "soft_light": lambda b, s: f"CASE WHEN {s} <= 0.5 THEN {b} - (1 - 2 * {s}) * {b} * (1 - {b}) ELSE {b} + (2 * {s} - 1) * ((CASE WHEN {b} <= 0.25 THEN ((16 * {b} - 12) * {b} + 4) * {b} ELSE sqrt({b}) END) - {b}) END",
    "difference": lambda b, s: f"abs({b} - {s})", "exclusion": lambda b, s: f"{b} + {s} - 2 * {b} * {s}", "linear_burn": lambda b, s: f"greatest({b} + {s} - 1, 0)", "linear_dodge": lambda b, s: f"least({b} + {s}, 1)",
    "vivid_light": lambda b, s: f"CASE WHEN {s} <= 0.5 THEN {_burn(b, f'(2 * {s})')} ELSE {_dodge(b, f'(2 * {s} - 1)')} END", "linear_light": lambda b, s: clamp(f"{b} + 2 * {s} - 1"),
    "pin_light": lambda b, s: f"CASE WHEN {s} <= 0.5 THEN least({b}, 2 * {s}) ELSE greatest({b}, 2 * {s} - 1) END", "hard_mix": lambda b, s: f"CASE WHEN {b} + {s} < 1 THEN 0 ELSE 1 END",
    "subtract": lambda b, s: f"greatest({b} - {s}, 0)", "divide": lambda b, s: f"CASE WHEN {s} = 0 THEN 1 ELSE least({b} / {s}, 1) END",
}


def composed(mixed: tuple[str, str, str], *ctes: str, source: str = "pair", opacity: float = 0.75) -> str:
    al = f"(a2 * {opacity})"
    rgb = (f"{al} * (1 - a) * s{c} + {al} * a * ({m}) + (1 - {al}) * a * b{c}" for c, m in zip("rgb", mixed, strict=True))
    return final(source, *rgb, f"{al} + a * (1 - {al})", PAIR, *ctes)


def _set_luma(triple: tuple[str, str, str], light: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Two steps: shifted colours, then clipped to the range at equal luma."""
    shift = f"shift AS (SELECT *, {light} AS lum, {triple[0]} + {light} - {luma(*triple)} AS tr, {triple[1]} + {light} - {luma(*triple)} AS tg, {triple[2]} + {light} - {luma(*triple)} AS tb FROM sat)"
    low = "lows AS (SELECT *, " + luma("tr", "tg", "tb") + " AS tl, least(tr, tg, tb) AS lo, greatest(tr, tg, tb) AS hi FROM shift)"
    up = lambda c: f"(CASE WHEN lo < 0 AND tl <> lo THEN tl + ({c} - tl) * tl / (tl - lo) WHEN lo < 0 THEN tl ELSE {c} END)"
    return (shift, low), tuple(f"CASE WHEN hi > 1 AND hi <> tl THEN tl + ({up(c)} - tl) * (1 - tl) / (hi - tl) WHEN hi > 1 THEN tl ELSE {up(c)} END" for c in ("tr", "tg", "tb"))


def _non_separable(name: str) -> str:
    lb, ls = luma("br", "bg", "bb"), luma("sr", "sg", "sb")
    if name in ("darker_color", "lighter_color"):
        sign = "<=" if name == "darker_color" else ">="
        return composed(tuple(f"CASE WHEN {lb} {sign} {ls} THEN b{c} ELSE s{c} END" for c in "rgb"))
    src, other = ("s", "b") if name == "hue" else ("b", "s")
    lo, hi = f"least({src}r, {src}g, {src}b)", f"greatest({src}r, {src}g, {src}b)"
    amount = f"(greatest({other}r, {other}g, {other}b) - least({other}r, {other}g, {other}b))"
    scaled = [f"CASE WHEN {hi} > {lo} THEN ({src}{c} - {lo}) * {amount} / ({hi} - {lo}) ELSE 0 END" for c in "rgb"]
    sat = f"sat AS (SELECT *, {scaled[0]} AS hr, {scaled[1]} AS hg, {scaled[2]} AS hb FROM pair)"
    triple, light = {"hue": (("hr", "hg", "hb"), lb), "saturation": (("hr", "hg", "hb"), lb), "color": (("sr", "sg", "sb"), lb), "luminosity": (("br", "bg", "bb"), ls)}[name]
    steps, mixed = _set_luma(triple, light)
    return composed(mixed, sat, *steps, source="lows")


COMPOSE = {f"compose.{n}": composed(tuple(f(f"b{c}", f"s{c}") for c in "rgb")) for n, f in CHANNEL_BLENDS.items()}
COMPOSE |= {f"compose.{n}": _non_separable(n) for n in ("hue", "saturation", "color", "luminosity", "darker_color", "lighter_color")}


def smooth(lo, hi, x) -> str:
    t = clamp(f"(({x}) - ({lo})) / (({hi}) - ({lo}))")
    return f"({t} * {t} * (3 - 2 * {t}))"


def restored(*out: str) -> tuple[str, ...]:
    return tuple(clamp(f"{e} + {LUM} - {luma(*out)}") for e in out)


def _level(ib, iw, gm, ob=0.0, ow=1.0):
    return f"{ob} + pow({clamp(f'(@ - {ib}) / ({iw} - {ib})')}, {1 / gm!r}) * ({ow} - {ob})"


def _hue(degrees: float) -> tuple[str, ...]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    m = (
        (0.213 + c * 0.787 - s * 0.213, 0.715 - c * 0.715 - s * 0.715, 0.072 - c * 0.072 + s * 0.928),
        (0.213 - c * 0.213 + s * 0.143, 0.715 + c * 0.285 + s * 0.140, 0.072 - c * 0.072 - s * 0.283),
        (0.213 - c * 0.213 - s * 0.787, 0.715 - c * 0.715 + s * 0.715, 0.072 + c * 0.928 + s * 0.072),
    )
    return tuple(f"r * {a!r} + g * {b!r} + b * {d!r}" for a, b, d in m)


_DARK, _BRIGHT = f"(1 - {smooth(0, 0.5, LUM)})", smooth(0.5, 1, LUM)
_LO, _HI = "least(r, g, b)", "greatest(r, g, b)"
_MID = f"(r + g + b - {_LO} - {_HI})"


def _balance(c, s, m, h):
    return f"({c} + {s} * {_DARK} + {m} * (1 - {_DARK} - {_BRIGHT}) + {h} * {_BRIGHT})"


def _gray(one, two):
    return f"{_LO} + ({_MID} - {_LO}) * {two} + ({_HI} - {_MID}) * {one}"


_BW = f"""(CASE WHEN r >= g AND g >= b THEN {_gray(0.4, 0.6)} WHEN g >= r AND r >= b THEN {_gray(0.4, 0.6)} WHEN g >= b AND b >= r THEN {_gray(0.4, 0.6)}
 WHEN b >= g AND g >= r THEN {_gray(0.2, 0.6)} WHEN b >= r AND r >= g THEN {_gray(0.2, 0.8)} ELSE {_gray(0.4, 0.8)} END)"""


def _lerp(f, place: str) -> str:
    """Between the entries f(floor), f(floor + 1) of a table given by a formula of its index."""
    i = f"floor({place})"
    return f"({f(i)} + ({f(f'least({i} + 1, 255)')} - {f(i)}) * ({place} - {i}))"


ADJUST = {
    "adjust.exposure": final("px", *(f"{c} * {2**0.5!r}" for c in "rgb"), "a"), "adjust.brightness_contrast": straight_each("(@ - 0.5) * 1.3 + 0.5 + 0.1"), "adjust.levels": straight_each(_level(0.1, 0.9, 1.2, 0.05, 0.95)),
    "adjust.levels_rgb": straight(*(_level(*p).replace("@", c) for c, p in zip("rgb", ((0.1, 0.9, 1.2), (0.0, 0.8, 0.8), (0.2, 1.0, 1.0)), strict=True))), "adjust.saturation": straight_each(f"{LUM} + (@ - {LUM}) * 1.4"),
    "adjust.hue_rotate": straight(*_hue(40.0)), "adjust.invert_rgb": straight_each("1 - @"), "adjust.white_balance": straight("r * 1.1", "g * 0.95", "b * 0.9"),
    "adjust.vibrance": straight_each(f"{LUM} + (@ - {LUM}) * (1 + 0.1 + 0.5 * (1 - ({_HI} - {_LO})))"),
    "adjust.color_balance": straight(*restored(_balance("r", 0.1, 0.05, -0.1), _balance("g", 0.0, 0.1, 0.05), _balance("b", -0.1, 0.0, 0.1))), "adjust.black_white": straight(_BW, _BW, _BW),
    "adjust.posterize": straight_each(f"least(floor({clamp('@')} * 5) / 4, 1)"), "adjust.threshold": final("px", *[f"CASE WHEN {LUM} >= a * 0.5 THEN a ELSE 0 END"] * 3, "a"),
    "adjust.photo_filter": straight(*restored("r + (r * 1.0 - r) * 0.25", "g + (g * 0.6 - g) * 0.25", "b + (b * 0.2 - b) * 0.25")),
    "adjust.lut1d": straight_each(_lerp(lambda i: f"(({i}) * ({i}) / 65025.0)", f"({clamp('@')} * 255)")),
    "adjust.gradient_map": straight(*(_lerp(f, f"({clamp(LUM709)} * 255)") for f in (lambda i: f"(({i}) / 255.0)", lambda i: f"(1 - ({i}) / 255.0)", lambda i: f"(({i}) * ({i}) / 65025.0)"))),
    "adjust.lut3d": straight(clamp("g"), clamp("b"), clamp("r")), "adjust.channel_mixer": straight("r * 0.8 + g * 0.1 + b * 0.1 + 0.0", "r * 0.2 + g * 0.7 + b * 0.1 + 0.05", "r * 0.0 + g * 0.3 + b * 0.7 + -0.05"),
    "adjust.selective_color": straight(*(clamp(f"{c} + {clamp(f'({-ink} - 0.1 * (1 + {ink})) * (1 - {c})', f'-{c}', f'1 - {c}')} * (CASE WHEN r = {_HI} THEN {_HI} - {_MID} ELSE 0 END)") for c, ink in zip("rgb", (0.3, -0.2, 0.1), strict=True))),
}

# -- kernels that read neighbours -------------------------------------------------------------------


def taps(places) -> str:
    """t: one row for each place and tap, with both pixels (q: the tap's)."""
    values = ", ".join(f"({', '.join(map(str, p))})" for p in places)
    names = "dx, dy" + (", k" if len(places[0]) > 2 else "")
    at = lambda c, d, m: f"least(greatest(p.{c} + o.{d}, 0), {m})"
    return f"t AS (SELECT p.x, p.y, p.r, p.g, p.b, p.a, q.r AS qr, q.g AS qg, q.b AS qb, q.a AS qa, o.* FROM px p CROSS JOIN size CROSS JOIN (VALUES {values}) o({names}) JOIN px q ON q.x = {at('x', 'dx', 'w')} AND q.y = {at('y', 'dy', 'h')})"


SQUARE = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def grouped(places, template: str, alpha: str | None = None) -> str:
    """An aggregate over the taps of each place; @ is a channel of the place, q@ of the tap."""
    cols = ", ".join(f"{(template if c != 'a' or alpha is None else alpha).replace('@', c)} AS {c}" for c in "rgba")
    return final("s", *"rgba", SIZE, taps(places), f"s AS (SELECT t.x, t.y, {cols} FROM t GROUP BY t.x, t.y, t.r, t.g, t.b, t.a)")


def pick(dx: int, dy: int) -> str:
    return f"max(CASE WHEN dx = {dx} AND dy = {dy} THEN q@ END)"


_GX = f"(({pick(1, -1)} + 2 * {pick(1, 0)} + {pick(1, 1)}) - ({pick(-1, -1)} + 2 * {pick(-1, 0)} + {pick(-1, 1)}))"
_GY = f"(({pick(-1, 1)} + 2 * {pick(0, 1)} + {pick(1, 1)}) - ({pick(-1, -1)} + 2 * {pick(0, -1)} + {pick(1, -1)}))"
_EDGE = f"sqrt({_GX} * {_GX} + {_GY} * {_GY})"
_QL = luma("qr", "qg", "qb", (0.2126, 0.7152, 0.0722))
_LX, _LY, _LEDGE = (e.replace("q@", _QL) for e in (_GX, _GY, _EDGE))


def _gauss(sigma, r, along):
    raw = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-r, r + 1)}
    total = sum(raw.values())
    return grouped([(d, 0, repr(w / total)) if along == "x" else (0, d, repr(w / total)) for d, w in raw.items()], "sum(k * q@)")


def disc(r):
    n = math.ceil(r)
    return [(dx, dy) for dy in range(-n, n + 1) for dx in range(-n, n + 1) if dx * dx + dy * dy <= r * r]


def square(n):
    return [(dx, dy) for dy in range(-n, n + 1) for dx in range(-n, n + 1)]


def _spatial(n, sigma):
    return [(dx, dy, repr(math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)))) for dx, dy in square(n)]


_BIL = "(k * exp(-((qr - t.r) * (qr - t.r) + (qg - t.g) * (qg - t.g) + (qb - t.b) * (qb - t.b)) / (2 * 0.1 * 0.1)))"
_LENS = f"(CASE WHEN {_QL} > 0.6 THEN 1 + 2.0 * ({_QL} - 0.6) ELSE 1.0 END)"


def _moved(x: str, y: str, where: str = "") -> str:
    return final("m", *"rgba", SIZE, f"m AS (SELECT {x} AS x, {y} AS y, r, g, b, a FROM px CROSS JOIN size{where})")


def gathered(points: str, normalize: bool, edge: str = "clamp", *, ctes: tuple[str, ...] = ()) -> str:
    """points: a query for x, y, sx, sy, k over ``px`` or a grid; sources beyond the border are clamped, wrapped or left out."""
    at = {"clamp": ("least(greatest(sx, 0), w)", "least(greatest(sy, 0), h)"), "wrap": ("((sx % (w + 1)) + w + 1) % (w + 1)", "((sy % (h + 1)) + h + 1) % (h + 1)"), "zero": ("sx", "sy")}[edge]
    total = " / sum(k)" if normalize else ""
    cols = ", ".join(f"coalesce(sum(k * coalesce(q.{c}, 0)){total}, 0) AS {c}" for c in "rgba")
    return final("s", *"rgba", SIZE, *ctes, f"pts AS ({points})", f"s AS (SELECT p.x, p.y, {cols} FROM pts p CROSS JOIN size LEFT JOIN px q ON q.x = {at[0]} AND q.y = {at[1]} GROUP BY p.x, p.y)")


def bilinear(px: str, py: str, source: str = "px CROSS JOIN size") -> str:
    return f"""SELECT x, y, floor(fx) + i AS sx, floor(fy) + j AS sy, (CASE WHEN i = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) * (CASE WHEN j = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) AS k
 FROM (SELECT x, y, {px} AS fx, {py} AS fy FROM {source}) CROSS JOIN (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) b(j)"""


def _resized(w: int, h: int, reach: int, weight) -> str:
    grid = f"(SELECT gx.x AS x, gy.y AS y, (gx.x + 0.5) * (w + 1) / {w}.0 - 0.5 AS fx, (gy.y + 0.5) * (h + 1) / {h}.0 - 0.5 AS fy FROM range({w}) gx(x) CROSS JOIN range({h}) gy(y) CROSS JOIN size)"
    if weight is None:
        return gathered(f"SELECT x, y, floor(fx + 0.5) AS sx, floor(fy + 0.5) AS sy, 1.0 AS k FROM {grid}", True)
    span = f"range({1 - reach}, {reach + 1})"
    return gathered(f"SELECT x, y, floor(fx) + i AS sx, floor(fy) + j AS sy, {weight('(fx - floor(fx) - i)')} * {weight('(fy - floor(fy) - j)')} AS k FROM {grid} CROSS JOIN {span} a(i) CROSS JOIN {span} b(j)", True)


def _mitchell(t):
    return f"(CASE WHEN abs({t}) < 1 THEN (7 * pow(abs({t}), 3) - 12 * {t} * {t} + 16.0 / 3) / 6 WHEN abs({t}) < 2 THEN (-7.0 / 3 * pow(abs({t}), 3) + 12 * {t} * {t} - 20 * abs({t}) + 32.0 / 3) / 6 ELSE 0 END)"


def _lanczos(t):
    return f"(CASE WHEN abs({t}) >= 3 THEN 0 WHEN abs({t}) < 1e-9 THEN 1 ELSE sin(pi() * {t}) / (pi() * {t}) * sin(pi() * {t} / 3) / (pi() * {t} / 3) END)"


_C, _S = math.cos(math.radians(20)), math.sin(math.radians(20))

SPATIAL = {
    "conv.box": grouped(SQUARE, "sum(q@) / 9"), "conv.gaussian_h": _gauss(1.2, 3, "x"), "conv.gaussian_v": _gauss(1.2, 3, "y"), "conv.unsharp": both("CASE WHEN abs(@ - @2) > 0.1 THEN @ + 0.8 * (@ - @2) ELSE @ END"),
    "conv.emboss": grouped(SQUARE, clamp(f"0.5 + ({pick(1, -1)} - {pick(-1, 1)}) * 1.5 * 0.5"), "t.a"), "conv.find_edges": grouped(SQUARE, clamp(f"1 - {_EDGE} * 0.8"), "t.a"),
    "conv.lens": grouped(disc(2.0), f"sum({_LENS} * q@) / sum({_LENS})"), "conv.bilateral": grouped(_spatial(2, 1.0), f"t.@ + (sum({_BIL} * q@) / sum({_BIL}) - t.@) * 0.9"),
    "morph.dilate": grouped(SQUARE, "max(q@)"), "morph.erode": grouped(SQUARE, "min(q@)"), "rank.median3": grouped(SQUARE, "list_sort(list(q@))[5]"),
    "rank.despeckle": grouped(SQUARE, "t.@ + ((CASE WHEN list_sort(list(q@))[8] - list_sort(list(q@))[2] <= 0.2 THEN list_sort(list(q@))[5] ELSE t.@ END) - t.@) * 0.75", "t.a"),
    "rank.dust_scratches": grouped(square(2), "CASE WHEN abs(t.@ - list_sort(list(q@))[13]) > 0.1 THEN list_sort(list(q@))[13] ELSE t.@ END", "t.a"),
    "resample.nearest": _resized(8, 100, 0, None), "resample.mitchell": _resized(8, 100, 2, _mitchell), "resample.lanczos3": _resized(8, 100, 3, _lanczos),
    "geom.flip_h": _moved("15 - x", "y"), "geom.flip_v": _moved("x", "h - y"), "geom.rotate90_cw": _moved("h - y", "x"), "geom.rotate90_ccw": _moved("y", "15 - x"),
    "geom.crop": _moved("x - 4", "y - 10", " WHERE x BETWEEN 4 AND 11 AND y BETWEEN 10 AND 109"), "geom.mosaic": gathered("SELECT x, y, floor(floor(x / 4.0) * 4 + 2) AS sx, floor(floor(y / 4.0) * 4 + 2) AS sy, 1.0 AS k FROM px", True),
    "geom.offset": gathered(bilinear("x - 2.5", "y + 1.25"), False, "wrap"),
    "geom.rotate_bilinear": gathered(bilinear(f"(x - w / 2.0) * {_C!r} + (y - h / 2.0) * {_S!r} + w / 2.0", f"(y - h / 2.0) * {_C!r} - (x - w / 2.0) * {_S!r} + h / 2.0"), False),
    "geom.warp_backward": gathered(bilinear("CASE WHEN rr < 1 THEN 8 + (x - 8) * (1 + 0.5 * (1 - rr)) ELSE x END", "CASE WHEN rr < 1 THEN 8 + (y - 8) * (1 + 0.5 * (1 - rr)) ELSE y END", "(SELECT x, y, sqrt((x - 8.0) * (x - 8) + (y - 8.0) * (y - 8)) / 8 AS rr FROM px)"), False),
}

# -- generators and gallery -------------------------------------------------------------------------


def generated(r, g, b, a) -> str:
    return final("px", r, g, b, a)


def ramp(t: str) -> str:
    return generated(*(f"{p} + ({q} - {p}) * ({t})" for p, q in zip((0.1, 0.2, 0.3, 1.0), (0.9, 0.7, 0.5, 0.5), strict=True)))


def pcg(v: str) -> str:
    state = f"((({v}) * 747796405 + 2891336453) & 4294967295)"
    word = f"((xor({state} >> CAST(({state} >> 28) + 4 AS INTEGER), {state}) * 277803737) & 4294967295)"
    return f"xor({word} >> 22, {word})"


def noise(x: str, y: str, seed: int) -> str:
    whole = lambda v: f"(CAST({v} AS BIGINT) & 4294967295)"
    return f"(({pcg(f'xor({whole(x)}, ' + pcg(f'xor({whole(y)}, ' + pcg(f'{seed}::BIGINT') + ')') + ')')} >> 8) / 16777216.0)"


_ATAN = "(((((0.0208351 * zz + -0.0851330) * zz + 0.1801410) * zz + -0.3302995) * zz + 0.9998660) * z)"


def _angular() -> str:
    steps = f"""ang AS (SELECT x, y, dx, dy, CASE WHEN greatest(abs(dx), abs(dy)) = 0 THEN 0 ELSE least(abs(dx), abs(dy)) / greatest(abs(dx), abs(dy)) END AS z FROM (SELECT x, y, x - 7.5 AS dx, y - 8.25 AS dy FROM px)),
 an2 AS (SELECT *, z * z AS zz FROM ang), an3 AS (SELECT *, CASE WHEN abs(dy) > abs(dx) THEN pi() / 2 - {_ATAN} ELSE {_ATAN} END AS q1 FROM an2),
 an4 AS (SELECT *, CASE WHEN dx < 0 THEN pi() - q1 ELSE q1 END AS q2 FROM an3), an5 AS (SELECT x, y, {clamp("((CASE WHEN dy < 0 THEN -q2 ELSE q2 END) + pi()) / (2 * pi())")} AS t FROM an4)"""
    return final("an5", *(f"{p} + ({q} - {p}) * t" for p, q in zip((0.1, 0.2, 0.3, 1.0), (0.9, 0.7, 0.5, 0.5), strict=True)), steps)


_PROJ = "((x - 2.0) * 10 + (y - 3.0) * 5) / 125"


def styled(r, g, b, amount=0.8, *ctes: str, source="px") -> str:
    return final(source, *(f"{c} + ({e} - {c}) * {amount}" for c, e in zip("rgb", (r, g, b), strict=True)), "a", *ctes)


def _halftone(c: str, turn: float) -> str:
    co, si = math.cos(math.radians(30 + turn)), math.sin(math.radians(30 + turn))
    u, v = f"((x * {co!r} - y * {si!r}) / 4.0)", f"((x * {si!r} + y * {co!r}) / 4.0)"
    far = f"(sqrt(({u} - floor({u}) - 0.5) * ({u} - floor({u}) - 0.5) + ({v} - floor({v}) - 0.5) * ({v} - floor({v}) - 0.5)) * 4.0)"
    rad = f"(sqrt(1 - {clamp(c)}) * 4.0 * {math.sqrt(0.5)!r})"
    return smooth(f"{rad} - 0.5", f"{rad} + 0.5", far)


def _hatch(k: int) -> str:
    angle = math.radians(45) + math.pi * k / 2
    u = f"((x * {math.cos(angle)!r} + y * {math.sin(angle)!r}) / 4.0)"
    half = f"(0.5 * {clamp(f'(1 - {LUM709}) * 0.9')})"
    return f"(CASE WHEN {half} <= 0 THEN 1 ELSE {smooth(f'{half} - 0.125', f'{half} + 0.125', f'abs({u} - floor({u}) - 0.5)')} END)"


_RELIEF = f"(0.5 + ({_LX} * {math.cos(math.radians(45))!r} + {_LY} * {-math.sin(math.radians(45))!r}) * 0.25 * {math.cos(math.radians(30))!r})"
_CANVAS = "(0.5 + 0.25 * (sin(({x}) * {k!r}) + sin(({y}) * {k!r})))"


def _canvas(x, y):
    return _CANVAS.format(x=x, y=y, k=2 * math.pi / 5.0)


_TEX = clamp(f"1 + (({_canvas('x + 1', 'y')} - {_canvas('x - 1', 'y')}) * {math.cos(math.radians(45))!r} + ({_canvas('x', 'y + 1')} - {_canvas('x', 'y - 1')}) * {-math.sin(math.radians(45))!r}) * 1.5", "0", "2")

GENERATED = {
    "gen.solid": generated("0.1", "0.2", "0.3", "0.4"), "gen.checker": ramp("CAST((floor(x / 3.0) + floor(y / 3.0)) AS BIGINT) % 2"), "gen.linear_gradient": ramp(clamp(_PROJ)), "gen.reflected_gradient": ramp(clamp(f"abs({_PROJ})")),
    "gen.radial_gradient": ramp(clamp("sqrt((x - 8.0) * (x - 8) + (y - 8.0) * (y - 8)) / 20")), "gen.angular_gradient": _angular(), "gen.diamond_gradient": ramp(clamp("(abs(x - 7.5) + abs(y - 8.25)) / 30")),
    "gen.noise": generated(*[noise("x", "y", 42) + " * 0.5"] * 3, "1"),
    "gallery.posterize_edges": grouped(SQUARE, f"t.@ + ({clamp(f'least(floor({clamp('t.@')} * 4), 3) / 3.0 * (1 - {smooth(0.2, 0.25, _LEDGE)} * 0.9)')} - t.@) * 0.8", "t.a"),
    "gallery.glowing_edges": grouped(SQUARE, f"t.@ + ({clamp(f'{_EDGE} * 0.7')} + ({smooth(0, 1, clamp(f'{_EDGE} * 0.7'))} - {clamp(f'{_EDGE} * 0.7')}) * 0.5 - t.@) * 0.8", "t.a"),
    "gallery.halftone": styled(_halftone("r", 15), _halftone("g", 75), _halftone("b", 0)), "gallery.grain": styled(*(clamp(f"{c} + {noise('floor(x / 2.0)', 'floor(y / 2.0)', s)} - 0.5") for c, s in zip("rgb", (7, 7 ^ 2654435769, 7 ^ 2246822507), strict=True))),
    "gallery.crosshatch": styled(*[clamp(f"{_hatch(0)} * {_hatch(1)}")] * 3), "gallery.threshold_ink": styled(*[smooth(0.4, 0.6, LUM709)] * 3),
    "gallery.bas_relief": grouped(SQUARE, f"t.@ + ({clamp(_RELIEF)} - t.@) * 0.8", "t.a"), "gallery.texturizer": styled(*(clamp(f"{c} * {_TEX}") for c in "rgb")),
}

# -- kernels whose places or weights take more than one step ------------------------------------------

_STEPS = [i / 8 - 1 for i in range(17)]


def _mean_of(sx: str, sy: str, source: str = "px") -> str:
    """The mean over t = -1, -7/8 .. 1 of the pixels at (sx, sy)."""
    steps = ", ".join(f"({t!r}::DOUBLE)" for t in _STEPS)
    return gathered(f"SELECT x, y, round_even({sx}, 0) AS sx, round_even({sy}, 0) AS sy, 1.0 AS k FROM {source} CROSS JOIN (VALUES {steps}) o(t)", True)


_SHARP = _spatial(2, 1.0)
_SOFT = f"(sum(k * q@) / {sum(float(k) for _, _, k in _SHARP)!r})"
_FLAT = f"(greatest({', '.join(f'abs(t.{c} - ' + _SOFT.replace('@', c) + ')' for c in 'rgb')}) < 0.02)"
# the second image is the raster read from right to left: its shape is 5 wide and 4 high
_SHAPE = f"""kernel AS (SELECT a.d AS dx, b.d AS dy, m.r AS k FROM (VALUES (-2), (-1), (0), (1), (2)) a(d) CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) b(d)
 JOIN px m ON m.x = 15 - least(CAST(floor((a.d + 2.5) * 5 / 5.0) AS BIGINT), 4) AND m.y = least(CAST(floor((b.d + 2.5) * 4 / 5.0) AS BIGINT), 3) WHERE m.r > 0),
 t AS (SELECT p.x, p.y, p.r, p.g, p.b, p.a, q.r AS qr, q.g AS qg, q.b AS qb, q.a AS qa, k FROM px p CROSS JOIN size CROSS JOIN kernel o JOIN px q ON q.x = least(greatest(p.x + o.dx, 0), w) AND q.y = least(greatest(p.y + o.dy, 0), h)),
 s AS (SELECT t.x, t.y, {', '.join(f't.{c} + (sum(k * q{c}) / sum(k) - t.{c}) * 0.8 AS {c}' for c in 'rgba')} FROM t GROUP BY t.x, t.y, t.r, t.g, t.b, t.a)"""
_QUADS = [(q, dx, dy) for q in range(4) for dy in range(-2 * (q < 2), 2 * (q > 1) + 1) for dx in range(-2 * (q % 2 == 0), 2 * (q % 2) + 1)]
_KUWAHARA = f"""t AS (SELECT p.x, p.y, o.q, q.r AS qr, q.g AS qg, q.b AS qb FROM px p CROSS JOIN size CROSS JOIN (VALUES {', '.join(map(str, _QUADS))}) o(q, dx, dy) JOIN px q ON q.x = least(greatest(p.x + dx, 0), w) AND q.y = least(greatest(p.y + dy, 0), h)),
 m AS (SELECT x, y, q, avg(qr) AS mr, avg(qg) AS mg, avg(qb) AS mb, greatest(avg({_QL} * {_QL}) - avg({_QL}) * avg({_QL}), 0) AS v FROM t GROUP BY x, y, q),
 n AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY round(v, 12), q) AS rank FROM m), s AS (SELECT px.*, mr, mg, mb FROM px JOIN n ON n.x = px.x AND n.y = px.y AND rank = 1)"""


def _shown(points: str, *ctes: str, shade: str = "1") -> str:
    """Each place's pixel blended by 0.8 with the one at (sx, sy), clamped; ``points`` has x, y, sx, sy and what the shade needs."""
    cols = ", ".join(f"px.{c} + ({f'least(greatest(q.{c} * {shade}, 0), 1)' if shade != '1' else f'q.{c}'} - px.{c}) * 0.8 AS {c}" for c in "rgb")
    alpha = "px.a" if shade != "1" else "px.a + (q.a - px.a) * 0.8"
    return final("s", *"rgba", SIZE, *ctes, f"pts AS ({points})", f"s AS (SELECT px.x, px.y, {cols}, {alpha} AS a FROM pts p CROSS JOIN size JOIN px ON px.x = p.x AND px.y = p.y JOIN px q ON q.x = least(greatest(p.sx, 0), w) AND q.y = least(greatest(p.sy, 0), h))")


_ANGLE, _RAD = f"({noise('x', 'y', 5)} * 2 * pi())", f"(sqrt({noise('x', 'y', 5 ^ 668265261)}) * 3.0)"
_DX, _DY = math.cos(math.radians(30)), -math.sin(math.radians(30))


def _value_noise(x: str, y: str) -> list[str]:
    """The steps of smooth noise at (x, y): places in the lattice, then their four corners mixed."""
    u, v = (f"({f} * {f} * (3 - 2 * {f}))" for f in (f"({x} - floor({x}))", f"({y} - floor({y}))"))
    h = lambda i, j: noise(f"floor({x}) + {i}", f"floor({y}) + {j}", 9)
    low, high = (f"({h(0, j)} + ({h(1, j)} - {h(0, j)}) * {u})" for j in (0, 1))
    return f"({low} + ({high} - {low}) * {v})"


_GLASS = f"""lattice AS (SELECT x, y, {', '.join(f'{_value_noise(f"(x / 4.0 + {dx})", f"(y / 4.0 + {dy})")} AS n{k}' for k, (dx, dy) in enumerate(((0.5, 0.0), (-0.5, 0.0), (0.0, 0.5), (0.0, -0.5))))} FROM px)"""
_SITES = f"""cell AS (SELECT x, y, x / 4.0 AS fx, y / 4.0 AS fy, floor(x / 4.0) + i AS cx, floor(y / 4.0) + j AS cy, (j + 1) * 3 + i + 1 AS n FROM px CROSS JOIN (VALUES (-1), (0), (1)) a(i) CROSS JOIN (VALUES (-1), (0), (1)) b(j)),
 site AS (SELECT x, y, fx, fy, n, cx + {noise('cx', 'cy', 3)} AS sx, cy + {noise('cx', 'cy', 3 ^ 3037000493)} AS sy FROM cell),
 far AS (SELECT *, sqrt((fx - sx) * (fx - sx) + (fy - sy) * (fy - sy)) AS d FROM site), ranked AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY d, n) AS rank FROM far)"""
_PANES = """SELECT a.x, a.y, a.x + least(greatest(round_even(a.sx * 4 - a.x, 0), -24), 24) AS sx, a.y + least(greatest(round_even(a.sy * 4 - a.y, 0), -24), 24) AS sy, (b.d - a.d) * 0.5 AS gap FROM ranked a JOIN ranked b ON a.x = b.x AND a.y = b.y AND a.rank = 1 AND b.rank = 2"""


def _pattern() -> str:
    """The corner of 5 x 3 of the raster read from right to left, turned by 25 degrees and scaled by 1.7, over the raster at 0.6."""
    c, s = math.cos(math.radians(25)), math.sin(math.radians(25))
    qx, qy = "(x + 0.5 - 1.25)", "(y + 0.5 + 2.5)"
    places = f"SELECT x, y, ({qx} * {c!r} + {qy} * {s!r}) / 1.7 - 0.5 AS fx, ({qy} * {c!r} - {qx} * {s!r}) / 1.7 - 0.5 AS fy FROM px"
    wrap = lambda v, n: f"(CAST(({v}) % {n} AS BIGINT) + {n}) % {n}"
    taps_ = f"""SELECT x, y, {wrap('floor(fx) + i', 5)} AS sx, {wrap('floor(fy) + j', 3)} AS sy, (CASE WHEN i = 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) * (CASE WHEN j = 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) AS k
 FROM ({places}) CROSS JOIN (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) b(j)"""
    mixed = ", ".join(f"sum(k * q.{c}) AS s{c}" for c in "rgba")
    return final("m", *(f"s{c} * 0.6 + {c} * (1 - sa * 0.6)" for c in "rgb"), "sa * 0.6 + a * (1 - sa * 0.6)", f"t AS ({taps_})", f"u AS (SELECT t.x, t.y, {mixed} FROM t JOIN px q ON q.x = 15 - t.sx AND q.y = t.sy GROUP BY t.x, t.y)", "m AS (SELECT px.*, sr, sg, sb, sa FROM px JOIN u ON u.x = px.x AND u.y = px.y)")


def _move_selection() -> str:
    """The raster read from right to left selects by its red channel; what it selects arrives at (2.5, -1.25)."""
    c = bilinear("x - 2.5", "y + 1.25", "px")
    sums = ", ".join([*(f"sum(k * coalesce(q.{c}, 0)) AS p{c}" for c in "rgba"), "sum(k * coalesce(m.r, 0)) AS there"])
    return final("s", *(f"{c} * (1 - there) + p{c} * there" for c in "rgba"), f"t AS ({c})", f"u AS (SELECT t.x, t.y, {sums} FROM t LEFT JOIN px q ON q.x = t.sx AND q.y = t.sy LEFT JOIN px m ON m.x = 15 - t.sx AND m.y = t.sy GROUP BY t.x, t.y)", "s AS (SELECT px.*, pr, pg, pb, pa, there FROM px JOIN u ON u.x = px.x AND u.y = px.y)")


_MDX, _MDY = math.cos(math.radians(35)) * 3.5, -math.sin(math.radians(35)) * 3.5
_RADIAL = "(SELECT x, y, mx, my, rad, atan2(y - my, x - mx) AS ang FROM (SELECT x, y, (w + 1) * 0.5 AS mx, (h + 1) * 0.5 AS my, sqrt((x - (w + 1) * 0.5) * (x - (w + 1) * 0.5) + (y - (h + 1) * 0.5) * (y - (h + 1) * 0.5)) AS rad FROM px CROSS JOIN size))"

STEPPED = {
    "conv.motion": _mean_of(f"x + t * {_MDX!r}", f"y + t * {_MDY!r}"), "conv.radial": _mean_of("mx + cos(ang + t * 0.1) * rad", "my + sin(ang + t * 0.1) * rad", _RADIAL),
    "conv.smart_sharpen": grouped(_SHARP, f"CASE WHEN {_FLAT} THEN t.@ ELSE {clamp(f't.@ + {clamp(f'(t.@ - {_SOFT}) * 1.5', '-0.2', '0.2')}')} END", "t.a"),
    "conv.shape": final("s", *"rgba", SIZE, _SHAPE), "geom.move_selection": _move_selection(), "gen.pattern": _pattern(),
    "gallery.kuwahara": final("s", *(f"{c} + ({clamp('m' + c)} - {c}) * 0.8" for c in "rgb"), "a", SIZE, _KUWAHARA),
    "gallery.diffuse": _shown(f"SELECT x, y, x + round_even(cos(ang) * rad * {_DX!r} - sin(ang) * rad * 0.75 * {_DY!r}, 0) AS sx, y + round_even(cos(ang) * rad * {_DY!r} + sin(ang) * rad * 0.75 * {_DX!r}, 0) AS sy FROM (SELECT x, y, {_ANGLE} AS ang, {_RAD} AS rad FROM px)"),
    "gallery.glass": _shown("SELECT x, y, x + least(greatest(round_even((n0 - n1) * 6.0, 0), -16), 16) AS sx, y + least(greatest(round_even((n2 - n3) * 6.0, 0), -16), 16) AS sy FROM lattice", _GLASS),
    "gallery.stained_glass": _shown(_PANES, _SITES, shade=f"(1 - (1 - {smooth(0, 0.1, 'gap')}))"),
}

KERNEL_SQL = POINT | COMPOSE | ADJUST | SPATIAL | GENERATED | STEPPED
