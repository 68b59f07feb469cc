"""Column-level helpers: draw keys, array expressions, adjusted moments."""

from assay_spark.functions.keys import draw_key, key_int, draw_int, uniform
from assay_spark.functions.arrays import (
    as_double_array, vsum, sq_dist, dot, vmax_abs, scale, pair_products,
    outer_product, correlators, any_nan,
)
from assay_spark.functions.moments import skew_adj, kurt_adj

__all__ = [
    "draw_key", "key_int", "draw_int", "uniform", "as_double_array", "vsum",
    "sq_dist", "dot", "vmax_abs", "scale", "pair_products", "outer_product",
    "correlators", "any_nan", "skew_adj", "kurt_adj",
]
