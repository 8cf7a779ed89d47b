"""Blends and adjustments for arrays of pixels: rows of r, g, b, or of r, g, b, a. The formulas of ``operators/point.py``, step by step in
the same order, for folds that choose them by name. Where a channel is no number it is missing: comparisons with it are false, and the
least or greatest of some is that of the others."""

from __future__ import annotations

import math

import numpy as np

from gridspark.functions.pixel import LUMA_ADJUST


def ratio(a, b, otherwise=0.0):
    return np.where(b == 0, otherwise, a / np.where(b == 0, 1.0, b))


def clamp(v):
    return np.fmin(np.fmax(v, 0.0), 1.0)


def luma(c):
    return c[:, 0] * LUMA_ADJUST[0] + c[:, 1] * LUMA_ADJUST[1] + c[:, 2] * LUMA_ADJUST[2]


def _col(v):
    return np.asarray(v)[:, None]


def _screen(b, s):
    return b + s - b * s


def _hard(b, s):
    return np.where(s <= 0.5, b * (2 * s), _screen(b, 2 * s - 1))


def _dodge(b, s):
    return np.where(b == 0, 0.0, np.where(s >= 1, 1.0, np.fmin(1.0, ratio(b, 1 - s, 1.0))))


def _burn(b, s):
    return np.where(b >= 1, 1.0, np.where(s <= 0, 0.0, 1 - np.fmin(1.0, ratio(1 - b, s, 1.0))))


def _soft(b, s):
    d = np.where(b <= 0.25, ((16 * b - 12) * b + 4) * b, np.sqrt(np.fmax(b, 0.0)))
    return np.where(s <= 0.5, b - (1 - 2 * s) * b * (1 - b), b + (2 * s - 1) * (d - b))


def _low(c):
    return np.fmin(np.fmin(c[:, 0], c[:, 1]), c[:, 2])


def _high(c):
    return np.fmax(np.fmax(c[:, 0], c[:, 1]), c[:, 2])


def _set_luma(c, light):
    c = c + _col(light - luma(c))
    low, high, light = _col(_low(c)), _col(_high(c)), _col(luma(c))
    up = np.where(low < 0, light + ratio((c - light) * light, light - low), c)
    return np.where(high > 1, light + ratio((up - light) * (1 - light), high - light), up)


def _set_saturation(c, s):
    low, high = _col(_low(c)), _col(_high(c))
    return np.where(high > low, ratio((c - low) * _col(s), high - low), 0.0)


#: Of the straight colours below and above.
BLENDS = {
    "normal": lambda b, s: s,
    "multiply": lambda b, s: b * s,
    "screen": _screen,
    "overlay": lambda b, s: _hard(s, b),
    "darken": np.fmin,
    "lighten": np.fmax,
    "color_dodge": _dodge,
    "color_burn": _burn,
    "hard_light": _hard,
    "soft_light": _soft,
    "difference": lambda b, s: np.abs(b - s),
    "exclusion": lambda b, s: b + s - 2 * b * s,
    "linear_burn": lambda b, s: np.fmax(b + s - 1, 0.0),
    "linear_dodge": lambda b, s: np.fmin(b + s, 1.0),
    "vivid_light": lambda b, s: np.where(s <= 0.5, _burn(b, 2 * s), _dodge(b, 2 * s - 1)),
    "linear_light": lambda b, s: clamp(b + 2 * s - 1),
    "pin_light": lambda b, s: np.where(s <= 0.5, np.fmin(b, 2 * s), np.fmax(b, 2 * s - 1)),
    "hard_mix": lambda b, s: np.where(b + s < 1, 0.0, 1.0),
    "subtract": lambda b, s: np.fmax(b - s, 0.0),
    "divide": lambda b, s: np.where(s == 0, 1.0, np.fmin(ratio(b, s, 1.0), 1.0)),
    "hue": lambda b, s: _set_luma(_set_saturation(s, _high(b) - _low(b)), luma(b)),
    "saturation": lambda b, s: _set_luma(_set_saturation(b, _high(s) - _low(s)), luma(b)),
    "color": lambda b, s: _set_luma(s, luma(b)),
    "luminosity": lambda b, s: _set_luma(b, luma(s)),
    "darker_color": lambda b, s: np.where(_col(luma(b) <= luma(s)), b, s),
    "lighter_color": lambda b, s: np.where(_col(luma(b) >= luma(s)), b, s),
}


def straight(p):
    """r, g, b, a without the alpha that the colour is multiplied by."""
    out = ratio(p, p[:, 3:])
    out[:, 3] = p[:, 3]
    return out


def blended(below, plate, names, codes, opacity):
    """``plate`` (straight) over ``below`` (premultiplied), each row by the blend that its code has in ``names``; a code that has none is normal."""
    cb, cs = straight(below)[:, :3], plate[:, :3]
    mixed = cs.copy()
    for code in np.unique(codes):
        if code >= 0:
            mine = codes == code
            mixed[mine] = BLENDS[names[code]](cb[mine], cs[mine])
    alpha, under = _col(plate[:, 3] * opacity), below[:, 3:]
    rgb = alpha * (1 - under) * cs + alpha * under * mixed + (1 - alpha) * under * cb
    return np.concatenate([rgb, alpha + under * (1 - alpha)], axis=1)


def _mix_luma(c, k):
    light = _col(luma(c))
    return light + (c - light) * k


def _power_of_two(v):
    values, at = np.unique(v, return_inverse=True)
    return np.array([math.pow(2.0, x) if x < 1024 else x * math.inf for x in values])[at]


def _levels(c, in_black, in_white, gamma, out_black, out_white):
    t = np.where(in_white == in_black, np.where(c > in_black, 1.0, 0.0), clamp(ratio(c - in_black, in_white - in_black)))
    return out_black + np.power(t, ratio(1.0, gamma, 1.0)) * (out_white - out_black)


def _straight(f):
    return lambda p, *amounts: np.concatenate([f(straight(p)[:, :3], *amounts) * p[:, 3:], p[:, 3:]], axis=1)


def _exposure(p, ev):
    return np.concatenate([p[:, :3] * _col(_power_of_two(ev[:, 0])), p[:, 3:]], axis=1)


def _threshold(p, threshold):
    v = _col(np.where(luma(p) >= p[:, 3] * threshold[:, 0], p[:, 3], 0.0))
    return np.concatenate([v, v, v, p[:, 3:]], axis=1)


#: Adjustments of premultiplied pixels, with the amounts that they have where none are given.
ADJUSTMENTS = {
    "exposure": (_exposure, (0.0,)),
    "brightness_contrast": (_straight(lambda c, brightness, contrast: (c - 0.5) * contrast + 0.5 + brightness), (0.0, 1.0)),
    "saturation": (_straight(_mix_luma), (1.0,)),
    "white_balance": (_straight(lambda c, temp, tint: c * np.concatenate([1 + temp, 1 + tint, 1 - temp], axis=1)), (0.0, 0.0)),
    "vibrance": (_straight(lambda c, vibrance, saturation: _mix_luma(c, 1 + saturation + vibrance * (1 - _col(_high(c) - _low(c))))), (0.0, 0.0)),
    "threshold": (_threshold, (0.5,)),
    "invert_rgb": (_straight(lambda c: 1 - c), ()),
    "levels": (_straight(_levels), (0.0, 1.0, 1.0, 0.0, 1.0)),
}


def adjusted(p, names, codes, amounts):
    """Each row by the adjustment that its code has in ``names``; a code that has none changes nothing. ``amounts``: a row each, NaN where none is given."""
    out = p.copy()
    for code in np.unique(codes):
        if code >= 0:
            mine = codes == code
            f, defaults = ADJUSTMENTS[names[code]]
            given = amounts[mine]
            out[mine] = f(p[mine], *(_col(np.where(np.isnan(given[:, i]), d, given[:, i])) for i, d in enumerate(defaults)))
    return out
