"""The registered queries of the raster engine: every kernel over the raster of embeddings, and the composed operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import gridspark.operators.gallery
import gridspark.operators.generators
import gridspark.operators.point
import gridspark.operators.spatial  # noqa: F401
from gridspark.functions.pixel import CHANNELS, rounded
from gridspark.oracle import KERNEL_SQL
from gridspark.plans.registry import KERNELS, apply
from gridspark.sources.rasters import height, mirrored, px_embed

_RAMP = {"c0": (0.1, 0.2, 0.3, 1.0), "c1": (0.9, 0.7, 0.5, 0.5)}

#: Parameters of the kernels' queries; the others run with their defaults.
PARAMS = {
    "math.linear": {"gain": 1.5, "bias": -0.2}, "math.add_const": {"v": 0.25}, "math.mul_const": {"v": 0.75}, "math.clamp": {"lo": 0.4, "hi": 0.6}, "math.min_const": {"v": 0.5}, "math.max_const": {"v": 0.5},
    "band.extract": {"channel": 1}, "band.set_alpha": {"alpha": 0.5}, "adjust.exposure": {"ev": 0.5}, "adjust.brightness_contrast": {"brightness": 0.1, "contrast": 1.3},
    "adjust.levels": {"in_black": 0.1, "in_white": 0.9, "gamma": 1.2, "out_black": 0.05, "out_white": 0.95}, "adjust.levels_rgb": {"r": (0.1, 0.9, 1.2), "g": (0.0, 0.8, 0.8), "b": (0.2, 1.0, 1.0)},
    "adjust.saturation": {"sat": 1.4}, "adjust.hue_rotate": {"degrees": 40.0}, "adjust.white_balance": {"temp": 0.1, "tint": -0.05}, "adjust.vibrance": {"vibrance": 0.5, "saturation": 0.1},
    "adjust.color_balance": {"shadows": (0.1, 0.0, -0.1), "mids": (0.05, 0.1, 0.0), "highlights": (-0.1, 0.05, 0.1)}, "adjust.posterize": {"levels": 5.0}, "adjust.lut1d": {"lut": [i * i / 65025 for i in range(256)]},
    "adjust.gradient_map": {"ramp": [(i / 255, 1 - i / 255, i * i / 65025) for i in range(256)]}, "adjust.lut3d": {"cube": [(g / 8, b / 8, r / 8) for b in range(9) for g in range(9) for r in range(9)]},
    "adjust.channel_mixer": {"red": (0.8, 0.1, 0.1, 0.0), "green": (0.2, 0.7, 0.1, 0.05), "blue": (0.0, 0.3, 0.7, -0.05)}, "adjust.selective_color": {"range": 0, "cyan": 0.3, "magenta": -0.2, "yellow": 0.1, "black": 0.1},
    "conv.gaussian_h": {"sigma": 1.2, "radius": 3}, "conv.gaussian_v": {"sigma": 1.2, "radius": 3}, "conv.unsharp": {"amount": 0.8, "threshold": 0.1}, "conv.emboss": {"angle_deg": 45.0, "height": 1.5}, "conv.find_edges": {"strength": 0.8},
    "conv.lens": {"radius_px": 2.0, "threshold": 0.6, "boost": 2.0}, "conv.bilateral": {"radius_px": 2.0, "sigma_range": 0.1, "amount": 0.9}, "rank.despeckle": {"edge_threshold": 0.2, "amount": 0.75},
    "resample.nearest": {"width": 8, "height": 100}, "resample.mitchell": {"width": 8, "height": 100}, "resample.lanczos3": {"width": 8, "height": 100}, 
    "geom.crop": {"off_x": 4, "off_y": 10, "width": 8, "height": 100}, "geom.offset": {"dx": 2.5, "dy": -1.25, "edge": 2}, "geom.rotate_bilinear": {"degrees": 20.0},
    "gen.solid": {"color": (0.1, 0.2, 0.3, 0.4)}, "gen.checker": {"size": 3, **_RAMP}, "gen.linear_gradient": {"x0": 2.0, "y0": 3.0, "x1": 12.0, "y1": 8.0, **_RAMP}, "gen.reflected_gradient": {"x0": 2.0, "y0": 3.0, "x1": 12.0, "y1": 8.0, **_RAMP},
    "gen.radial_gradient": {"radius": 20.0, **_RAMP}, "gen.angular_gradient": {"cx": 7.5, "cy": 8.25, **_RAMP}, "gen.diamond_gradient": {"cx": 7.5, "cy": 8.25, "scale": 30.0, **_RAMP}, "gen.noise": {"seed": 42, "amount": 0.5},
    "gallery.posterize_edges": {"edge_amount": 0.9, "amount": 0.8}, "gallery.glowing_edges": {"intensity": 0.7, "amount": 0.8}, "gallery.halftone": {"angle_deg": 30.0, "amount": 0.8}, "gallery.grain": {"seed": 7, "size_px": 2.0, "mono": 0, "amount": 0.8},
    "conv.motion": {"angle_deg": 35.0, "length_px": 7.0}, "conv.smart_sharpen": {"amount": 1.5, "threshold": 0.02, "clamp_hi": 0.2}, "conv.shape": {"radius_px": 2.5, "amount": 0.8, "shape_w": 5, "shape_h": 4}, "geom.move_selection": {"dx": 2.5, "dy": -1.25},
    "gen.pattern": {"scale": 1.7, "angle_deg": 25.0, "offset_x": 1.25, "offset_y": -2.5, "opacity": 0.6, "tile_w": 5, "tile_h": 3}, "gallery.kuwahara": {"amount": 0.8}, "gallery.diffuse": {"seed": 5, "angle_deg": 30.0, "anisotropy": 0.25, "amount": 0.8},
    "gallery.glass": {"seed": 9, "distortion": 6.0, "amount": 0.8}, "gallery.stained_glass": {"seed": 3, "amount": 0.8},
    "gallery.crosshatch": {"strength": 0.9, "amount": 0.8}, "gallery.threshold_ink": {"amount": 0.8}, "gallery.bas_relief": {"height": 2.0, "amount": 0.8}, "gallery.texturizer": {"scale_px": 5.0, "relief": 1.5, "amount": 0.8},
}
#: Kernels that are told the height of their input, and by which parameter.
HEIGHT = {"geom.flip_v": "height", "geom.rotate90_cw": "src_h"}
PARAMS |= {name: {"opacity": 0.75} for name in KERNELS if name.startswith("compose.")}


def shown(df: DataFrame) -> DataFrame:
    """Channels to six decimals, without negative zeros, so that engines' last bits don't show; 0 for what is not finite."""
    finite = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c))
    return df.select("x", "y", *(rounded(finite(c)).alias(c) for c in CHANNELS))


def kernel_query(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    px, params = px_embed(spark, sf_dir), PARAMS.get(name, {})
    if name in HEIGHT:
        params = params | {HEIGHT[name]: height(spark, sf_dir)}
    return shown(apply(px, name, other=mirrored(px) if KERNELS[name].inputs == 2 else None, **params))


def key(name: str) -> str:
    return "k_" + name.replace(".", "_")


QUERIES = {key(name): partial(kernel_query, name=name) for name in KERNELS}
ORACLE_SQL = {key(name): sql for name, sql in KERNEL_SQL.items()}
