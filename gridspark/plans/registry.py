"""The kernel registry: what is applied by name, with which inputs and parameters."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.pixel import CHANNELS, Px, mix
from gridspark.plans.stencil import at


class Kernel(NamedTuple):
    name: str
    inputs: int
    kind: str  # "point": pixel -> pixel; "frame": DataFrame -> DataFrame; "generator": extent -> DataFrame
    params: dict
    run: Callable


KERNELS: dict[str, Kernel] = {}


def kernel(name: str, inputs: int = 1, kind: str = "point", **params):
    """Registers a kernel with the defaults of its parameters; also how users add their own."""

    def add(f):
        KERNELS[name] = Kernel(name, inputs, kind, params, f)
        return f

    return add


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both pixels of a place; a missing second one is transparent black. A second raster without ``image_id`` is one for all images."""
    second = b.select(*at(b), *(F.col(c).alias(f"b_{c}") for c in CHANNELS))
    both = a.join(second, at(b), "left")
    return both.withColumns({f"b_{c}": F.coalesce(f"b_{c}", F.lit(0.0)) for c in CHANNELS})


def apply(df: DataFrame, name: str, other: DataFrame | None = None, mask: DataFrame | None = None, **params) -> DataFrame:
    """x, y, r, g, b, a (and image_id, level, if ``df`` has them) of a kernel's result over ``df``; ``mask`` (x, y, m) weighs it against the first input, 1 where absent."""
    k = KERNELS[name]
    unknown = set(params) - set(k.params)
    if unknown:
        raise TypeError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    if (other is not None) != (k.inputs == 2):
        raise TypeError(f"{name} takes {k.inputs} image(s)")
    params = k.params | params
    if k.kind == "point":
        rows = df if other is None else joined(df, other)
        args = (Px.of(),) if other is None else (Px.of(), Px.of("b_"))
        result = k.run(*args, **params)
    else:
        out = k.run(df, **params) if other is None else k.run(df, other, **params)
        if mask is None:
            return out
        rows = joined(df, out)
        result = Px.of("b_")
    if mask is not None:
        rows = rows.join(mask.select(*at(mask), "m"), at(mask), "left")
        m = F.coalesce("m", F.lit(1.0))
        result = Px.of().zip(result, lambda before, after: mix(before, after, m))
    return result.select(rows, *at(rows))
