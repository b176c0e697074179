"""The raster queries: each operator over rasters made of the driver's tables, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import core
from tessera.core import SQL, column, doubles, embedding_raster, formula, frame_raster, order_raster, pair_raster
from tessera.functions import colors, compose, escapes, fx, pointwise
from tessera.operators import channels, effects, geometry, layers, metrics, regions, resample, stats, transfer, virtual, windows
from tessera.sources import codecs, formats, images

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, build: Query, sql: str | None = None, digits: int = 4) -> None:
    """Registers a query; its doubles are rounded, so that both engines' last bits don't count."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(spark, sf_dir)
        return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def r4(expr: str, name: str, digits: int = 4) -> str:
    return f"round({expr}, {digits}) + 0e0 AS {name}"


def over_emb(name: str, spark_column, sql: str) -> None:
    """A function of one sample over the embedding rasters."""
    add(name, lambda s, d: embedding_raster(s, d).withColumn("v", spark_column()), f"SELECT image_id, y, x, {r4(sql, 'v')} FROM {SQL['emb']}")


# ---- samples -----------------------------------------------------------------------------------------------------
CONSTANTS = {"abs": -40000.0, "add_modulus": 30000.0, "and": 30000.0, "cosine": 3.0, "divide": 1.7, "exponential": 0.5, "inverse_log": 10.0, "left_shift": 2.0, "log": 20.0, "multiply": 1.3, "pow": 1.4, "right_shift": 3.0, "root_mean_square": 10.0, "set": 12345.0, "sine": 2.5, "or": 4096.0, "xor": 21845.0}
for _op, _template in pointwise.EVALUATE.items():
    _c = CONSTANTS.get(_op, 33000.0)
    over_emb(f"evaluate_{_op}", lambda o=_op, c=_c: pointwise.evaluate("v", o, c), formula(_template, v="v", c=_c))
CURVES = {
    "sinusoid": {"freq": 3.0, "phase": 90.0, "amp": 0.4, "bias": 0.5}, "arcsin": {"width": 0.5, "center": 0.5, "range": 1.0, "bias": 0.5}, "arctan": {"slope": 5.0, "center": 0.5, "range": 1.0, "bias": 0.5},
    "level": {"black": 10000.0, "white": 50000.0, "gamma": 1.5}, "levelize": {"black": 10000.0, "white": 50000.0, "gamma": 1.5}, "gamma": {"gamma": 2.2}, "sigmoidal": {"contrast": 5.0, "mid": 0.4}, "negate": {}, "solarize": {"at": 40000.0}, "clamp": {}, "perceptible": {"eps": 35000.0},
    "bilevel": {"at": 33000.0}, "black_threshold": {"at": 30000.0}, "white_threshold": {"at": 36000.0}, "range_threshold": {"lb": 20000.0, "lw": 30000.0, "hw": 36000.0, "hb": 45000.0}, "posterize": {"levels": 5.0}, "depth": {"bits": 6.0}, "colorize": {"blend": 30.0, "fill": 50000.0}, "tint": {"fill": 9000.0},
}
for _op, _k in CURVES.items():
    over_emb(f"curve_{_op}", lambda o=_op, k=_k: pointwise.curve("v", o, **k), formula(pointwise.CURVES[_op], v="v", **_k))
over_emb("function_polynomial", lambda: F.expr(doubles(pointwise.polynomial("v", [2.0, -3.0, 1.5, 0.25]))), "65535e0 * (((2e0 * v / 65535e0 - 3e0) * v / 65535e0 + 1.5e0) * v / 65535e0 + 0.25e0)")
over_emb("brightness_contrast", lambda: F.expr(doubles(pointwise.brightness_contrast("v", 10.0, 20.0))), "65535e0 * (100e0 / 80e0 * v / 65535e0 + (0.1e0 - 0.5e0) * 100e0 / 80e0 + 0.5e0)")

def _u() -> dict:
    return {"u": F.col("v") / 65535.0, "i": F.col("x").cast("double"), "j": F.col("y").cast("double")}


FX = {
    "arithmetic": ("u*0.5 + (i-j)/8 - 2^-3", "v / 65535e0 * 0.5e0 + (x - y) / 8e0 - pow(2e0, -3e0)"),
    "ternary": ("u > 0.5 && i%2 == 0 ? 1-u : u/2", "CASE WHEN v / 65535e0 > 0.5e0 AND x % 2 = 0 THEN 1 - v / 65535e0 ELSE v / 65535e0 / 2 END"),
    "functions": ("hypot(sin(u*pi), cos(u)) + ln(u+1) + logtwo(u+2) + log(u+1)", "sqrt(pow(sin(v / 65535e0 * pi()), 2) + pow(cos(v / 65535e0), 2)) + ln(v / 65535e0 + 1) + log2(v / 65535e0 + 2) + log10(v / 65535e0 + 1)"),
    "rounding": ("floor(u*10)+ceil(u*10)+round(u*10)+trunc(0-u*10)+int(u*7)+alt(i)+sign(u-0.5)", "floor(v / 65535e0 * 10) + ceil(v / 65535e0 * 10) + floor(v / 65535e0 * 10 + 0.5e0) + ceil(-v / 65535e0 * 10) + floor(v / 65535e0 * 7) + CASE WHEN x % 2 = 1 THEN -1 ELSE 1 END + CASE WHEN v / 65535e0 < 0.5e0 THEN -1 ELSE 1 END"),
    "statements": ("t = u*2; t -= 0.25; s = mod(t, 0.3); s + drc(u, 0.5) + squish(t) + clamp(t)", "(v / 65535e0 * 2 - 0.25e0) - floor((v / 65535e0 * 2 - 0.25e0) / 0.3e0) * 0.3e0 + v / 65535e0 / (0.5e0 * (v / 65535e0 - 1) + 1) + 1 / (1 + exp(-(v / 65535e0 * 2 - 0.25e0))) + least(greatest(v / 65535e0 * 2 - 0.25e0, 0), 1)"),
    "bits": ("(i << 2 | j & 3) + gcd(i+4, j+6) + !(i-j) + max(i, j) + min(u, 0.4)", "((CAST(x AS BIGINT) << 2) | (CAST(y AS BIGINT) & 3)) + gcd(x + 4, y + 6) + CASE WHEN x = y THEN 1 ELSE 0 END + greatest(x, y) + least(v / 65535e0, 0.4e0)"),
    "curves": ("gauss(u) + sinc(u) + tanh(u) + atan2(u, 0.5) + exp(0-u) + sqrt(u) + pow(u, 3) + if(i>3, 1, 0)", "exp(-pow(v / 65535e0, 2) / 2) / sqrt(2 * pi()) + CASE WHEN v = 0 THEN 1 ELSE sin(pi() * v / 65535e0) / (pi() * v / 65535e0) END + tanh(v / 65535e0) + atan2(v / 65535e0, 0.5e0) + exp(-v / 65535e0) + sqrt(v / 65535e0) + pow(v / 65535e0, 3) + CASE WHEN x > 3 THEN 1 ELSE 0 END"),
}
for _op, (_text, _sql) in FX.items():
    over_emb(f"fx_{_op}", lambda t=_text: 65535.0 * fx.compile_fx(t, _u()), f"65535e0 * ({_sql})")

# ---- colours -----------------------------------------------------------------------------------------------------
_unit = "(SELECT image_id, y, x, r / 65535e0 AS r, g / 65535e0 AS g, b / 65535e0 AS b FROM " + SQL["ord"] + ")"


def unit_colours(s: SparkSession, d: str) -> DataFrame:
    return order_raster(s, d).withColumns({c: F.col(c) / 65535.0 for c in "rgb"})


for _space in colors.SPACES:
    _parts = colors.forward(_space)
    add(
        f"colorspace_{_space}", lambda s, d, p=_parts: unit_colours(s, d).select("image_id", "y", "x", *(F.expr(e).alias(f"c{i}") for i, e in enumerate(p))),
        f"SELECT image_id, y, x, {', '.join(r4(e, f'c{i}', 9) for i, e in enumerate(_parts))} FROM {_unit}", 9,
    )
for _space in (*colors.LINEAR, "rgb", "hsv", "hsl", "hwb", "xyz", "lab"):  # there and back again
    add(
        f"colorspace_inverse_{_space}",
        lambda s, d, p=_space: unit_colours(s, d).select("image_id", "y", "x", *(F.expr(e).alias(f"c{i}") for i, e in enumerate(colors.forward(p)))).select("image_id", "y", "x", *(F.expr(e).alias(c) for c, e in zip("rgb", colors.inverse(p), strict=True))),
        f"SELECT image_id, y, x, {', '.join(r4(c, c, 3) for c in 'rgb')} FROM {_unit}", 3,
    )
for _name, _e in colors.INTENSITY.items():
    add(f"grayscale_{_name}", lambda s, d, e=_e: unit_colours(s, d).select("image_id", "y", "x", F.expr(doubles(e)).alias("v")), f"SELECT image_id, y, x, {r4(doubles(_e), 'v', 9)} FROM {_unit}", 9)
_M = ((0.9, 0.1, 0.0, 0.05), (0.2, 0.7, 0.1, 0.0), (0.0, 0.3, 0.6, -0.1))
add(
    "color_matrix", lambda s, d: unit_colours(s, d).select("image_id", "y", "x", *((F.col("r") * m[0] + F.col("g") * m[1] + F.col("b") * m[2] + m[3]).alias(c) for c, m in zip("rgb", _M, strict=True))),
    f"SELECT image_id, y, x, {', '.join(r4(f'r * {m[0]!r}e0 + g * {m[1]!r}e0 + b * {m[2]!r}e0 + ({m[3]!r}e0)', c) for c, m in zip('rgb', _M, strict=True))} FROM {_unit}",
)
add("channel_separate", lambda s, d: order_raster(s, d).unpivot(["image_id", "y", "x"], ["r", "g", "b"], "channel", "v"), f"SELECT image_id, y, x, channel, {r4('v', 'v')} FROM (UNPIVOT {SQL['ord']} ON r, g, b INTO NAME channel VALUE v)")
add("channel_combine", lambda s, d: frame_raster(s, d).where("scene < 3").groupBy("image_id", "y", "x").pivot("scene", [0, 1, 2]).agg(F.first("v")).toDF("image_id", "y", "x", "r", "g", "b"), f"SELECT image_id, y, x, {', '.join(r4(f'max(CASE WHEN scene = {i} THEN v END)', c) for i, c in enumerate('rgb'))} FROM {SQL['frames']} WHERE scene < 3 GROUP BY ALL")
add("opaque_paint", lambda s, d: unit_colours(s, d).withColumn("r", F.when(F.expr("(r - 0.5D) * (r - 0.5D) + (g - 0.5D) * (g - 0.5D) + (b - 0.5D) * (b - 0.5D) <= 0.12D"), 1.0).otherwise(F.col("r"))), f"SELECT image_id, y, x, {r4('CASE WHEN (r - 0.5e0) * (r - 0.5e0) + (g - 0.5e0) * (g - 0.5e0) + (b - 0.5e0) * (b - 0.5e0) <= 0.12e0 THEN 1e0 ELSE r END', 'r')}, {r4('g', 'g')}, {r4('b', 'b')} FROM {_unit}")
add("color_threshold", lambda s, d: unit_colours(s, d).select("image_id", "y", "x", F.when(F.col("r").between(0.2, 0.8) & F.col("g").between(0.1, 0.9) & F.col("b").between(0.0, 0.7), 65535.0).otherwise(0.0).alias("v")), f"SELECT image_id, y, x, CASE WHEN r BETWEEN 0.2e0 AND 0.8e0 AND g BETWEEN 0.1e0 AND 0.9e0 AND b BETWEEN 0e0 AND 0.7e0 THEN 65535e0 ELSE 0e0 END AS v FROM {_unit}")
_PALETTE = [(0.0, 0.0, 0.0), (65535.0, 0.0, 0.0), (0.0, 65535.0, 32768.0), (40000.0, 40000.0, 40000.0), (65535.0, 65535.0, 65535.0)]
_far = lambda i: f"round((r - {_PALETTE[i][0]}e0) * (r - {_PALETTE[i][0]}e0) + (g - {_PALETTE[i][1]}e0) * (g - {_PALETTE[i][1]}e0) + (b - {_PALETTE[i][2]}e0) * (b - {_PALETTE[i][2]}e0), 6)"
_index = f"CAST(list_position([{', '.join(map(_far, range(5)))}], list_min([{', '.join(map(_far, range(5)))}])) - 1 AS INT)"
add("remap_nearest", lambda s, d: regions.remap(order_raster(s, d), _PALETTE).select("image_id", "y", "x", "index"), f"SELECT image_id, y, x, {_index} AS index FROM {SQL['ord']}")
add("quantize_cube", lambda s, d: regions.quantize(order_raster(s, d), 2), f"WITH q AS (SELECT *, least(floor(r / 65536e0 * 4), 3) AS qr, least(floor(g / 65536e0 * 4), 3) AS qg, least(floor(b / 65536e0 * 4), 3) AS qb FROM {SQL['ord']}) SELECT image_id, y, x, {', '.join(r4(f'avg({c}) OVER (PARTITION BY image_id, qr, qg, qb)', c) for c in 'rgb')} FROM q")
add("kmeans_round", lambda s, d: s.createDataFrame([(i, *c) for i, c in enumerate(regions.kmeans(order_raster(s, d), _PALETTE, 1))], "index int, r double, g double, b double"), f"WITH a AS (SELECT {_index} AS index, r, g, b FROM {SQL['ord']}), m AS (SELECT index, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM a GROUP BY index), p(index, r, g, b) AS (VALUES {', '.join(f'({i}, {c[0]}e0, {c[1]}e0, {c[2]}e0)' for i, c in enumerate(_PALETTE))}) SELECT CAST(p.index AS INT) AS index, {', '.join(r4(f'coalesce(m.{c}, p.{c})', c, 3) for c in 'rgb')} FROM p LEFT JOIN m USING (index)", 3)

# ---- statistics --------------------------------------------------------------------------------------------------
_moments = "count(*) AS n, avg(v) AS m, sum(v) AS s1, sum(v * v) AS s2"
_STATS = f"""
WITH e AS (SELECT * FROM {SQL['emb']}),
b AS (SELECT image_id, count(*) AS n, avg(v) AS m, min(v) AS lo, max(v) AS hi, quantile_disc(v, 0.5) AS med FROM e GROUP BY image_id),
c AS (SELECT image_id, sum(pow(v - m, 2)) / any_value(n) AS m2, sum(pow(v - m, 3)) / any_value(n) AS m3, sum(pow(v - m, 4)) / any_value(n) AS m4 FROM e JOIN b USING (image_id) GROUP BY image_id),
h AS (SELECT image_id, floor(least(greatest(v, 0e0), 65535e0) + 0.5e0) AS bin, count(*) AS k FROM e GROUP BY ALL),
t AS (SELECT image_id, sum(k) AS n, count(*) AS bins FROM h GROUP BY image_id),
p AS (SELECT image_id, CASE WHEN any_value(bins) > 1 THEN -sum(h.k / t.n * log2(h.k / t.n)) / log2(any_value(bins)) ELSE 0 END AS entropy FROM h JOIN t USING (image_id) GROUP BY image_id)
"""
add(
    "image_statistics", lambda s, d: stats.statistics(embedding_raster(s, d)),
    _STATS + f"""SELECT image_id, n AS area, {r4('lo', 'minima')}, {r4('hi', 'maxima')}, {r4('m', 'mean')}, {r4('m2 * n / (n - 1)', 'variance', 2)}, {r4('sqrt(m2 * n / (n - 1))', 'standard_deviation')},
    {r4('m3 / pow(m2 * n / (n - 1), 1.5e0)', 'skewness')}, {r4('m4 / pow(m2 * n / (n - 1), 2) - 3', 'kurtosis')}, {r4('med', 'median')}, {r4('entropy', 'entropy')} FROM b JOIN c USING (image_id) JOIN p USING (image_id)""",
)
QUERIES["image_statistics"] = lambda s, d: (lambda df: df.select(*((F.round(F.col(c), 2 if c == "variance" else 4) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)))(stats.statistics(embedding_raster(s, d)))
add("image_entropy", lambda s, d: stats.entropy(embedding_raster(s, d)), _STATS + f"SELECT image_id, {r4('entropy', 'entropy')} FROM p")
add("image_extrema", lambda s, d: stats.extrema(embedding_raster(s, d)), f"SELECT image_id, CAST(ceil(min(v) - 0.5e0) AS BIGINT) AS minima, CAST(floor(max(v) + 0.5e0) AS BIGINT) AS maxima, (list(y ORDER BY v, y, x))[1] AS min_y, (list(x ORDER BY v, y, x))[1] AS min_x, (list(y ORDER BY v DESC, y, x))[1] AS max_y, (list(x ORDER BY v DESC, y, x))[1] AS max_x FROM {SQL['emb']} GROUP BY image_id")
add(
    "image_moments", lambda s, d: stats.moments(embedding_raster(s, d)).select("image_id", "centroid_x", "centroid_y", "major", "minor", "eccentricity"),
    f"""WITH c AS (SELECT image_id, sum(v) AS s, sum(v * x) / sum(v) AS cx, sum(v * y) / sum(v) AS cy FROM {SQL['emb']} GROUP BY image_id),
    m AS (SELECT image_id, any_value(cx) AS cx, any_value(cy) AS cy, sum(v * pow(x - cx, 2)) / any_value(s) AS a, sum(v * pow(y - cy, 2)) / any_value(s) AS b, sum(v * (x - cx) * (y - cy)) / any_value(s) AS c FROM {SQL['emb']} JOIN c USING (image_id) GROUP BY image_id),
    q AS (SELECT *, sqrt(2 * (a + b + sqrt(4 * c * c + (a - b) * (a - b)))) AS major, sqrt(2 * (a + b - sqrt(4 * c * c + (a - b) * (a - b)))) AS minor FROM m)
    SELECT image_id, {r4('cx', 'centroid_x')}, {r4('cy', 'centroid_y')}, {r4('major', 'major')}, {r4('minor', 'minor')}, {r4('sqrt(1 - minor * minor / (major * major))', 'eccentricity')} FROM q""",
)
add("histogram", lambda s, d: stats.histogram(order_raster(s, d)), f"SELECT image_id, {r4('r', 'r')}, {r4('g', 'g')}, {r4('b', 'b')}, count(*) AS count FROM {SQL['ord']} GROUP BY image_id, {SQL['ord'] and 'r, g, b'}")
add("unique_colors", lambda s, d: stats.unique_colors(order_raster(s, d)), f"SELECT image_id, {r4('r', 'r')}, {r4('g', 'g')}, {r4('b', 'b')}, CAST(row_number() OVER (PARTITION BY image_id ORDER BY r, g, b) - 1 AS INT) AS x FROM (SELECT DISTINCT image_id, r, g, b FROM {SQL['ord']})")
add("number_colors", lambda s, d: stats.number_colors(order_raster(s, d)), f"SELECT image_id, count(*) AS colors, count(*) <= 256 AS palette, count(*) <= 1024 AS histogram FROM (SELECT DISTINCT image_id, r, g, b FROM {SQL['ord']}) GROUP BY image_id")
add("image_kinds", lambda s, d: stats.kinds(order_raster(s, d)), f"SELECT image_id, bool_and(abs(r - g) < 1e-12 AND abs(g - b) < 1e-12) AS gray, bool_and(r IN (0, 65535) AND r = g AND g = b) AS monochrome, bool_or(r < 0 OR r > 65535 OR r <> round_even(r, 0)) AS high_dynamic_range FROM {SQL['ord']} GROUP BY image_id")
add("ink_density", lambda s, d: stats.ink_density(order_raster(s, d), ("r", "g", "b")), f"SELECT image_id, {r4('max(r + g + b)', 'density')} FROM {SQL['ord']} GROUP BY image_id")
add("bounding_box", lambda s, d: stats.bounding_box(embedding_raster(s, d).withColumn("v", F.when(F.col("v") > 38000, F.col("v")).otherwise(0.0)), "0D"), f"SELECT image_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM {SQL['emb']} WHERE v > 38000 GROUP BY image_id")
add(
    "texture_features", lambda s, d: stats.texture(embedding_raster(s, d)),
    f"""WITH q AS (SELECT image_id, y, x, CAST(floor(least(v / 65535e0 * 8, 7e0)) AS INT) AS i FROM {SQL['emb']}),
    o AS (SELECT a.image_id, a.i, b.i AS j FROM q a JOIN q b ON a.image_id = b.image_id AND a.y = b.y AND b.x = a.x + 1),
    w AS (SELECT * FROM o UNION ALL SELECT image_id, j, i FROM o), k AS (SELECT image_id, i, j, count(*) AS c FROM w GROUP BY ALL),
    p AS (SELECT *, c / sum(c) OVER (PARTITION BY image_id) AS p FROM k)
    SELECT image_id, {r4('sum(p * p)', 'angular_second_moment', 9)}, {r4('sum(p * (i - j) * (i - j))', 'contrast', 9)}, {r4('sum(p / (1 + (i - j) * (i - j)))', 'inverse_difference', 9)}, {r4('-sum(p * log2(p))', 'entropy', 9)}, {r4('sum(p * (i + j))', 'sum_average', 9)} FROM p GROUP BY image_id""", 9,
)

# ---- two images --------------------------------------------------------------------------------------------------
_ab = f"(SELECT image_id, y, x, sc AS a, dc AS b FROM {SQL['pair']})"


def ab(s: SparkSession, d: str) -> DataFrame:
    return pair_raster(s, d).select("image_id", "y", "x", F.col("sc").alias("a"), F.col("dc").alias("b"))


for _name in metrics.METRICS:
    add(f"metric_{_name}", lambda s, d, n=_name: metrics.compare(ab(s, d), (n,)), f"SELECT image_id, {r4(metrics.metric(_name), _name)} FROM {_ab} GROUP BY image_id")
add("compare_highlight", lambda s, d: metrics.highlight(ab(s, d)), f"SELECT image_id, y, x, {r4('a', 'a')}, {r4('b', 'b')}, (a - b) * (a - b) > {0.01 * 0.01!r}e0 AS differs FROM {_ab}".replace("1e-05e0", "1e-05"))
add("compare_metrics", lambda s, d: metrics.compare(ab(s, d), ("mae", "mse", "rmse", "pae", "ncc")), f"SELECT image_id, {', '.join(r4(metrics.metric(n), n) for n in ('mae', 'mse', 'rmse', 'pae', 'ncc'))} FROM {_ab} GROUP BY image_id")
for _op in compose.BLENDS:
    _c, _a = compose.blended(_op)
    add(f"composite_{_op}", lambda s, d, o=_op: compose.composite(pair_raster(s, d), o).select("image_id", "y", "x", "c", "a"), f"SELECT image_id, y, x, {r4(_c, 'c', 9)}, {r4(_a, 'a', 9)} FROM {SQL['pair']}", 9)
_cx = "(SELECT image_id, y, x, sc AS ar, sa AS ai, dc AS br, da AS bi FROM " + SQL["pair"] + ")"
for _op, _re, _im in (
    ("add", "ar + br", "ai + bi"), ("subtract", "ar - br", "ai - bi"), ("multiply", "ar * br - ai * bi", "ar * bi + ai * br"), ("divide", "(ar * br + ai * bi) / (br * br + bi * bi)", "(ai * br - ar * bi) / (br * br + bi * bi)"),
    ("conjugate", "ar", "-ai"), ("magnitude_phase", "sqrt(ar * ar + ai * ai)", "atan2(ai, ar) / (2 * pi()) + 0.5e0"), ("real_imaginary", "ar * cos(2 * pi() * (ai - 0.5e0))", "ar * sin(2 * pi() * (ai - 0.5e0))"),
):
    add(
        f"complex_{_op}", lambda s, d, o=_op: layers.complex_pairs(pair_raster(s, d).selectExpr("image_id", "y", "x", "sc as ar", "sa as ai", "dc as br", "da as bi"), o).select("image_id", "y", "x", "real", "imaginary"),
        f"SELECT image_id, y, x, {r4(_re, 'real')}, {r4(_im, 'imaginary')} FROM {_cx}",
    )

# ---- histogram transfer ------------------------------------------------------------------------------------------
_h = f"""WITH e AS (SELECT *, CAST(least(greatest(floor(v / 65535e0 * 255 + 0.5e0), 0), 255) AS INT) AS bin FROM {SQL['emb']}), h0 AS (SELECT image_id, bin, count(*) AS n FROM e GROUP BY ALL),
h AS (SELECT *, CAST(sum(n) OVER (PARTITION BY image_id ORDER BY bin) AS BIGINT) AS below, CAST(sum(n) OVER (PARTITION BY image_id) AS BIGINT) AS total FROM h0)"""
add("equalize", lambda s, d: transfer.equalize(embedding_raster(s, d)), _h + f", l AS (SELECT *, min(below) OVER (PARTITION BY image_id) AS first FROM h) SELECT image_id, y, x, {r4('CASE WHEN total > first THEN 65535e0 * (below - first) / (total - first) ELSE v END', 'v')} FROM e JOIN l USING (image_id, bin)")
for _name, _b, _w in (("contrast_stretch", 0.1, 0.9), ("normalize", 0.02, 0.99)):
    add(f"{_name}", lambda s, d, b=_b, w=_w: transfer.contrast_stretch(embedding_raster(s, d), b, w), _h + f", k AS (SELECT image_id, min(CASE WHEN below > {_b}e0 * total THEN bin END) AS low, max(CASE WHEN total - below + n > {1 - _w!r}e0 * total THEN bin END) AS high FROM h GROUP BY image_id) SELECT image_id, y, x, {r4('CASE WHEN high > low THEN least(greatest((v - low * 257e0) / ((high - low) * 257e0) * 65535e0, 0), 65535e0) ELSE v END', 'v')} FROM e JOIN k USING (image_id)")
add("auto_level", lambda s, d: transfer.auto_level(embedding_raster(s, d)), f"SELECT image_id, y, x, {r4('65535e0 * (v - min(v) OVER (PARTITION BY image_id)) / (max(v) OVER (PARTITION BY image_id) - min(v) OVER (PARTITION BY image_id))', 'v')} FROM {SQL['emb']}")
add("auto_gamma", lambda s, d: transfer.auto_gamma(embedding_raster(s, d)), f"SELECT image_id, y, x, {r4('65535e0 * pow(v / 65535e0, ln(0.5e0) / ln(avg(v) OVER (PARTITION BY image_id) / 65535e0))', 'v')} FROM {SQL['emb']}")
_best = "SELECT image_id, CAST((list(bin ORDER BY round(worth, 9) DESC, bin))[1] AS INT) AS threshold FROM {t} GROUP BY image_id"
add("auto_threshold_otsu", lambda s, d: transfer.auto_threshold(embedding_raster(s, d), "otsu"), _h + ", q AS (SELECT image_id, bin, below / total AS w, sum(bin * n) OVER (PARTITION BY image_id ORDER BY bin) / total AS m, sum(bin * n) OVER (PARTITION BY image_id) / total AS mt FROM h), t AS (SELECT *, CASE WHEN w > 0 AND w < 1 THEN pow(mt * w - m, 2) / (w * (1 - w)) ELSE 0 END AS worth FROM q) " + _best.format(t="t"))
add("auto_threshold_kapur", lambda s, d: transfer.auto_threshold(embedding_raster(s, d), "kapur"), _h + ", q AS (SELECT image_id, bin, below / total AS w, sum(n / total * ln(n / total)) OVER (PARTITION BY image_id ORDER BY bin) AS e, sum(n / total * ln(n / total)) OVER (PARTITION BY image_id) AS et FROM h), t AS (SELECT *, CASE WHEN w > 0 AND w < 1 THEN ln(w) - e / w + ln(1 - w) - (et - e) / (1 - w) ELSE 0 END AS worth FROM q) " + _best.format(t="t"))
add("auto_threshold_triangle", lambda s, d: transfer.auto_threshold(embedding_raster(s, d), "triangle"), _h + ", q AS (SELECT h.*, max(n) OVER w AS pn, min(bin) OVER w AS first, max(bin) OVER w AS last FROM h WINDOW w AS (PARTITION BY image_id)), r AS (SELECT *, min(CASE WHEN n = pn THEN bin END) OVER (PARTITION BY image_id) AS pb FROM q), f AS (SELECT *, CASE WHEN pb - first > last - pb THEN first ELSE last END AS far FROM r), t AS (SELECT *, CASE WHEN far <> pb AND bin BETWEEN least(pb, far) AND greatest(pb, far) THEN abs(far - bin) * pn / abs(far - pb) - n ELSE 0 END AS worth FROM f) " + _best.format(t="t"))

# ---- geometry ----------------------------------------------------------------------------------------------------
for _name, _f, _y, _x, _where in (
    ("flip", geometry.flip, "7 - y", "x", ""), ("flop", geometry.flop, "y", "7 - x", ""), ("transpose", geometry.transpose, "x", "y", ""), ("transverse", geometry.transverse, "7 - x", "7 - y", ""),
    ("rotate_90", lambda e: geometry.rotate(e, 1), "x", "7 - y", ""), ("rotate_180", lambda e: geometry.rotate(e, 2), "7 - y", "7 - x", ""), ("rotate_270", lambda e: geometry.rotate(e, 3), "7 - x", "y", ""),
    ("roll", lambda e: geometry.roll(e, 3, -2), "(y + 6) % 8", "(x + 3) % 8", ""), ("crop", lambda e: geometry.crop(e, 2, 1, 4, 5), "y - 1", "x - 2", "WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 5"),
    ("shave", lambda e: geometry.shave(e, 2, 1), "y - 1", "x - 2", "WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6"), ("chop", lambda e: geometry.chop(e, 2, 3, 2, 1), "CASE WHEN y >= 4 THEN y - 1 ELSE y END", "CASE WHEN x >= 4 THEN x - 2 ELSE x END", "WHERE x NOT BETWEEN 2 AND 3 AND y <> 3"),
):
    add(_name, lambda s, d, f=_f: f(embedding_raster(s, d)), f"SELECT image_id, CAST({_y} AS INT) AS y, CAST({_x} AS INT) AS x, {r4('v', 'v')} FROM {SQL['emb']} {_where}")
_grid = lambda h, w: f"(SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT DISTINCT vec_id AS image_id FROM embeddings), range(0, {h}) a(y), range(0, {w}) b(x))"
add("extent", lambda s, d: geometry.extent(embedding_raster(s, d), 10, 9, 1, -2, 500.0), f"SELECT g.image_id, g.y, g.x, {r4('coalesce(v, 500e0)', 'v')} FROM {_grid(9, 10)} g LEFT JOIN {SQL['emb']} e ON e.image_id = g.image_id AND e.x + 1 = g.x AND e.y - 2 = g.y")
add("border", lambda s, d: geometry.border(embedding_raster(s, d), 2, 1, 700.0), f"SELECT g.image_id, g.y, g.x, {r4('coalesce(v, 700e0)', 'v')} FROM {_grid(10, 12)} g LEFT JOIN {SQL['emb']} e ON e.image_id = g.image_id AND e.x + 2 = g.x AND e.y + 1 = g.y")
add("splice", lambda s, d: geometry.splice(embedding_raster(s, d), 3, 2, 2, 1, 900.0), f"SELECT g.image_id, g.y, g.x, {r4('coalesce(v, 900e0)', 'v')} FROM {_grid(9, 10)} g LEFT JOIN {SQL['emb']} e ON e.image_id = g.image_id AND e.x + CASE WHEN e.x >= 3 THEN 2 ELSE 0 END = g.x AND e.y + CASE WHEN e.y >= 2 THEN 1 ELSE 0 END = g.y")
add("tiles", lambda s, d: geometry.tiles(embedding_raster(s, d), 3, 4), f"SELECT image_id, CAST(y % 4 AS INT) AS y, CAST(x % 3 AS INT) AS x, CAST(y // 4 AS INT) AS ty, CAST(x // 3 AS INT) AS tx, {r4('v', 'v')} FROM {SQL['emb']}")
add("append", lambda s, d: geometry.append(frame_raster(s, d)), f"SELECT image_id, y, CAST(scene * 8 + x AS INT) AS x, {r4('v', 'v')} FROM (SELECT image_id, y, x, v, dense_rank() OVER (PARTITION BY image_id ORDER BY scene) - 1 AS scene FROM {SQL['frames']})")
add("trim", lambda s, d: (lambda e: geometry.trim(e, stats.bounding_box(e, "0D")))(embedding_raster(s, d).withColumn("v", F.when(F.col("v") > 38000, F.col("v")).otherwise(0.0))), f"WITH e AS (SELECT image_id, y, x, CASE WHEN v > 38000 THEN v ELSE 0e0 END AS v FROM {SQL['emb']}), b AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM e WHERE v <> 0 GROUP BY image_id) SELECT image_id, CAST(y - y0 AS INT) AS y, CAST(x - x0 AS INT) AS x, {r4('v', 'v')} FROM e JOIN b USING (image_id) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
add("sort_pixels", lambda s, d: geometry.sort_pixels(embedding_raster(s, d)), f"SELECT image_id, y, CAST(row_number() OVER (PARTITION BY image_id, y ORDER BY v, x) - 1 AS INT) AS x, {r4('v', 'v')} FROM {SQL['emb']}")
add("montage", lambda s, d: layers.montage(frame_raster(s, d), 3), f"SELECT image_id, CAST((scene // 3) * 8 + y AS INT) AS y, CAST((scene % 3) * 8 + x AS INT) AS x, {r4('v', 'v')} FROM {SQL['frames']}")

# ---- neighbourhoods ----------------------------------------------------------------------------------------------
_near = lambda offsets: f"(SELECT e.image_id, e.y, e.x, o.k, n.v AS n FROM {SQL['emb']} e, (VALUES {', '.join(f'({a}, {b}, {float(k)!r}e0)' for a, b, k in offsets)}) o(dy, dx, k) JOIN {SQL['emb']} n ON n.image_id = e.image_id AND n.y = greatest(0, least(7, e.y + o.dy)) AND n.x = greatest(0, least(7, e.x + o.dx)))"
_box = [(a, b, 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1)]
for _name, _sql in (
    ("mean", "avg(n)"), ("minimum", "min(n)"), ("maximum", "max(n)"), ("gradient", "max(n) - min(n)"), ("contrast", "abs((max(n) - min(n)) / (max(n) + min(n)))"), ("rms", "sqrt(avg(n * n))"), ("standard_deviation", "stddev_pop(n)"), ("median", "(list(n ORDER BY n))[5]"),
):
    add(f"statistic_{_name}", lambda s, d, n=_name: windows.statistic(embedding_raster(s, d), n), f"SELECT image_id, y, x, {r4(_sql, 'v', 3)} FROM {_near(_box)} GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY image_id, y, x"), 3)
add("statistic_mode", lambda s, d: windows.statistic(embedding_raster(s, d).withColumn("v", F.floor(F.col("v") / 8192.0) * 8192.0), "mode"), f"SELECT image_id, y, x, {r4('(list(n ORDER BY c DESC, n))[1]', 'v')} FROM (SELECT image_id, y, x, floor(n / 8192e0) * 8192e0 AS n, count(*) AS c FROM {_near(_box)} GROUP BY 1, 2, 3, 4) GROUP BY image_id, y, x")
KERNELS = {"sobel": [[1.0, 0.0, -1.0], [2.0, 0.0, -2.0], [1.0, 0.0, -1.0]], "laplacian": [[-1.0, -1.0, -1.0], [-1.0, 8.0, -1.0], [-1.0, -1.0, -1.0]], "sharpen": [[0.0, -1.0, 0.0], [-1.0, 5.0, -1.0], [0.0, -1.0, 0.0]], "emboss": [[-2.0, -1.0, 0.0], [-1.0, 1.0, 1.0], [0.0, 1.0, 2.0]], "prewitt": [[1.0, 0.0, -1.0]] * 3, "binomial": [[0.0625, 0.125, 0.0625], [0.125, 0.25, 0.125], [0.0625, 0.125, 0.0625]], "edge": [[-1.0] * 3, [-1.0, 8.0, -1.0], [-1.0] * 3], "kirsch": [[5.0, -3.0, -3.0], [5.0, 0.0, -3.0], [5.0, -3.0, -3.0]]}
for _name, _k in KERNELS.items():
    add(f"convolve_{_name}", lambda s, d, k=_k: windows.convolve(embedding_raster(s, d), k), f"SELECT image_id, y, x, {r4('sum(n * k)', 'v', 3)} FROM {_near([(1 - i, 1 - j, _k[i][j]) for i in range(3) for j in range(3) if _k[i][j]])} GROUP BY image_id, y, x", 3)
_gk = windows.gaussian(1, 1.0)
add("blur", lambda s, d: windows.blur(embedding_raster(s, d)), f"SELECT image_id, y, x, {r4('sum(n * k)', 'v', 3)} FROM {_near([(a - 1, b - 1, _gk[a] * _gk[b]) for a in range(3) for b in range(3)])} GROUP BY image_id, y, x", 3)
add("unsharp", lambda s, d: windows.unsharp(embedding_raster(s, d)), f"SELECT image_id, y, x, {r4('CASE WHEN abs(v - q) * 2 < 3276.75e0 THEN v ELSE v + (v - q) END', 'v', 3)} FROM {SQL['emb']} JOIN (SELECT image_id, y, x, sum(n * k) AS q FROM {_near([(a - 1, b - 1, _gk[a] * _gk[b]) for a in range(3) for b in range(3)])} GROUP BY image_id, y, x) USING (image_id, y, x)", 3)


def _morph(source: str, cells: list, agg: str) -> str:
    """SQL of one erosion or dilation of a table (image_id, y, x, v)."""
    values = ", ".join(f"({-a if agg == 'max' else a}, {-b if agg == 'max' else b})" for a, b, _ in cells)
    return f"(SELECT e.image_id, e.y, e.x, {agg}(n.v) AS v FROM {source} e, (VALUES {values}) o(dy, dx) JOIN {source} n ON n.image_id = e.image_id AND n.y = greatest(0, least(7, e.y + o.dy)) AND n.x = greatest(0, least(7, e.x + o.dx)) GROUP BY e.image_id, e.y, e.x)"


for _shape in ("square", "plus", "cross", "line"):
    _cells = windows.SHAPES[_shape]
    _E = lambda t, c=_cells: _morph(t, c, "min")
    _D = lambda t, c=_cells: _morph(t, c, "max")
    _methods = {"dilate": _D("e0"), "erode": _E("e0"), "open": _D(_E("e0")), "close": _E(_D("e0"))} if _shape == "square" else {"dilate": _D("e0"), "erode": _E("e0")}
    for _m, _sql in _methods.items():
        add(f"morphology_{_m}_{_shape}", lambda s, d, m=_m, h=_shape: windows.morphology(embedding_raster(s, d), m, h), f"WITH e0 AS (SELECT * FROM {SQL['emb']}) SELECT image_id, y, x, {r4('v', 'v')} FROM {_sql}")
    if _shape == "square":
        for _m, (_a, _b) in {"edge_in": ("e0", _E("e0")), "edge_out": (_D("e0"), "e0"), "edge": (_D("e0"), _E("e0")), "top_hat": ("e0", _D(_E("e0"))), "bottom_hat": (_E(_D("e0")), "e0")}.items():
            add(f"morphology_{_m}", lambda s, d, m=_m: windows.morphology(embedding_raster(s, d), m), f"WITH e0 AS (SELECT * FROM {SQL['emb']}) SELECT image_id, p.y, p.x, {r4('p.v - q.v', 'v')} FROM {_a} p JOIN {_b} q USING (image_id, y, x)".replace("image_id, p.y, p.x", "image_id, y, x"))
        add("morphology_smooth", lambda s, d: windows.morphology(embedding_raster(s, d), "smooth"), f"WITH e0 AS (SELECT * FROM {SQL['emb']}), e1 AS (SELECT * FROM {_D(_E('e0'))}) SELECT image_id, y, x, {r4('v', 'v')} FROM {_E(_D('e1'))}")
add("adaptive_threshold", lambda s, d: windows.adaptive_threshold(embedding_raster(s, d).withColumn("v", F.round("v", 2)), bias=100.0), f"WITH e AS (SELECT image_id, y, x, round(v, 2) AS v FROM {SQL['emb']}) SELECT image_id, y, x, CASE WHEN v <= m + 100e0 THEN 0e0 ELSE 65535e0 END AS v FROM e JOIN (SELECT image_id, y, x, avg(round(n, 2)) AS m FROM {_near(_box)} GROUP BY image_id, y, x) USING (image_id, y, x)")
add("integral_image", lambda s, d: windows.integral(embedding_raster(s, d)), f"SELECT a.image_id, a.y, a.x, {r4('sum(b.v)', 'v', 3)} FROM {SQL['emb']} a JOIN {SQL['emb']} b ON a.image_id = b.image_id AND b.y <= a.y AND b.x <= a.x GROUP BY a.image_id, a.y, a.x", 3)
add("shade", lambda s, d: windows.shade(embedding_raster(s, d), 30.0, 40.0))

# ---- frames ------------------------------------------------------------------------------------------------------
for _op, _sql in (("mean", "avg(v)"), ("sum", "sum(v)"), ("max", "max(v)"), ("min", "min(v)"), ("rms", "sqrt(avg(v * v))"), ("median", "(list(v ORDER BY v))[count(*) // 2 + 1]"), ("add", "sum(v)"), ("multiply", "list_reduce(list(v ORDER BY scene), lambda a, b: a * b / 65535e0)"), ("subtract", "list_reduce(list(v ORDER BY scene), lambda a, b: b - a)"), ("divide", "list_reduce(list(v ORDER BY scene), lambda a, b: b / a)"), ("difference", "list_reduce(list(v ORDER BY scene), lambda a, b: abs(b - a))")):
    add(f"sequence_{_op}", lambda s, d, o=_op: layers.evaluate_sequence(frame_raster(s, d), o), f"SELECT image_id, y, x, {r4(_sql, 'v', 3)} FROM {SQL['frames']} GROUP BY image_id, y, x", 3)
_terms = [(0.4, 1.0), (0.3, 2.0), (0.2, 0.5), (0.1, 3.0), (0.05, 1.0)]
add("sequence_polynomial", lambda s, d: layers.polynomial(frame_raster(s, d), _terms), f"SELECT image_id, y, x, {r4('65535e0 * sum(w * pow(v / 65535e0, p))', 'v')} FROM {SQL['frames']} f JOIN (VALUES {', '.join(f'({i}, {w}e0, {p}e0)' for i, (w, p) in enumerate(_terms))}) t(scene, w, p) ON f.scene = t.scene GROUP BY image_id, y, x")
_coarse = f"(SELECT image_id, scene, y, x, floor(v / 16384e0) AS v FROM {SQL['frames']})"


def coarse(s: SparkSession, d: str) -> DataFrame:
    return frame_raster(s, d).withColumn("v", F.floor(F.col("v") / 16384.0).cast("double"))


add("layers_changed_box", lambda s, d: layers.changed_box(coarse(s, d)), f"SELECT image_id, scene, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM (SELECT *, lag(v) OVER (PARTITION BY image_id, y, x ORDER BY scene) AS p FROM {_coarse}) WHERE p IS NOT NULL AND p <> v GROUP BY image_id, scene")
add("layers_optimize_transparency", lambda s, d: layers.optimize_transparency(coarse(s, d)), f"SELECT image_id, scene, y, x, CASE WHEN lag(v) OVER (PARTITION BY image_id, y, x ORDER BY scene) = v THEN NULL ELSE v + 0e0 END AS v FROM {_coarse}")
add("layers_coalesce", lambda s, d: layers.coalesce(coarse(s, d).withColumn("v", F.when((F.col("v") == 1) & (F.col("scene") > 0), F.lit(None)).otherwise(F.col("v")))), f"SELECT image_id, scene, y, x, last_value(w IGNORE NULLS) OVER (PARTITION BY image_id, y, x ORDER BY scene) + 0e0 AS v FROM (SELECT *, CASE WHEN v = 1 AND scene > 0 THEN NULL ELSE v END AS w FROM {_coarse})")
add("layers_flatten", lambda s, d: layers.flatten(coarse(s, d).withColumn("v", F.when(F.col("v") == 2, F.lit(None)).otherwise(F.col("v")))), f"SELECT image_id, y, x, arg_max(v, scene) + 0e0 AS v FROM {_coarse} WHERE v <> 2 GROUP BY image_id, y, x")


def _flat(s: SparkSession, d: str) -> DataFrame:
    """Frames of which some are equal to the next."""
    return frame_raster(s, d).withColumn("v", F.floor(F.col("scene") * (1 + F.col("image_id") % 3) / 3).cast("double") + F.col("x"))


def _delays(s: SparkSession, d: str) -> DataFrame:
    return frame_raster(s, d).select("image_id", "scene").distinct().withColumn("delay", (F.col("scene") * 7 + F.col("image_id")) % 4 * (F.col("image_id") % 5))


_flat_sql = f"(SELECT image_id, scene, y, x, floor(scene * (1 + image_id % 3) / 3e0) + x AS v FROM {SQL['frames']})"
_delay_sql = f"(SELECT DISTINCT image_id, scene, (scene * 7 + image_id) % 4 * (image_id % 5) AS delay FROM {SQL['frames']})"
add("layers_remove_duplicates", lambda s, d: layers.remove_duplicates(_flat(s, d), _delays(s, d)), f"WITH f AS (SELECT *, lead(v) OVER (PARTITION BY image_id, y, x ORDER BY scene) AS nv FROM {_flat_sql}), q AS (SELECT image_id, scene, count(*) FILTER (WHERE nv = v) = count(*) AS same FROM f GROUP BY ALL), r AS (SELECT image_id, scene, delay, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY scene DESC) AS run FROM q JOIN {_delay_sql} USING (image_id, scene)) SELECT image_id, max(scene) AS scene, CAST(sum(delay) AS BIGINT) AS delay FROM r GROUP BY image_id, run")
add("layers_remove_zero", lambda s, d: layers.remove_zero_delays(_delays(s, d)), f"SELECT image_id, scene, delay FROM (SELECT *, max(delay) OVER (PARTITION BY image_id) AS m FROM {_delay_sql}) WHERE delay > 0 OR m <= 0")
add("layers_morph", lambda s, d: layers.morph(frame_raster(s, d), 2), f"WITH f AS (SELECT *, lead(v) OVER (PARTITION BY image_id, y, x ORDER BY scene) AS nv, dense_rank() OVER (PARTITION BY image_id ORDER BY scene) - 1 AS k FROM {SQL['frames']}) SELECT image_id, CAST(k * 3 + t AS INT) AS scene, y, x, {r4('CASE WHEN t = 0 THEN v ELSE (1 - t / 3e0) * v + t / 3e0 * nv END', 'v')} FROM f, range(0, 3) r(t) WHERE nv IS NOT NULL OR t = 0")
add("list_select", lambda s, d: layers.select_scenes(frame_raster(s, d), "0,2-3,-1"), f"SELECT image_id, scene, y, x, {r4('v', 'v')} FROM {SQL['frames']} f JOIN (SELECT image_id, max(scene) AS m FROM {SQL['frames']} GROUP BY image_id) USING (image_id) WHERE scene = 0 OR scene BETWEEN 2 AND 3 OR scene = m")
add("list_delete", lambda s, d: layers.delete_scenes(frame_raster(s, d), "1,-1"), f"SELECT image_id, scene, y, x, {r4('v', 'v')} FROM {SQL['frames']} f JOIN (SELECT image_id, max(scene) AS m FROM {SQL['frames']} GROUP BY image_id) USING (image_id) WHERE scene <> 1 AND scene <> m")
add("list_reverse", lambda s, d: layers.reverse(frame_raster(s, d)), f"SELECT image_id, max(scene) OVER (PARTITION BY image_id) - scene AS scene, y, x, {r4('v', 'v')} FROM {SQL['frames']}")
add("list_duplicate", lambda s, d: layers.duplicate(frame_raster(s, d), 1), f"SELECT image_id, CAST(scene + t * (max(scene) OVER (PARTITION BY image_id) + 1) AS INT) AS scene, y, x, {r4('v', 'v')} FROM {SQL['frames']}, range(0, 2) r(t)")

# ---- resampling --------------------------------------------------------------------------------------------------
for _name in resample.FILTERS:
    _t = ", ".join(f"({o}, {i}, {w!r}e0)".replace("e-0", "e-").replace("e-5e0", "e-5") if "e" not in repr(w) else f"({o}, {i}, {w!r})" for o, i, w in resample.taps(8, 5, _name))
    add(f"resize_{_name}", lambda s, d, n=_name: resample.resize(embedding_raster(s, d), 8, 8, 5, 5, n), f"WITH t(o, i, w) AS (VALUES {_t}) SELECT image_id, a.o AS y, b.o AS x, {r4('sum(v * a.w * b.w)', 'v', 3)} FROM {SQL['emb']} JOIN t a ON a.i = y JOIN t b ON b.i = x GROUP BY image_id, a.o, b.o", 3)
add("sample", lambda s, d: resample.sample(embedding_raster(s, d), 8, 8, 5, 3), f"SELECT image_id, CAST(p AS INT) AS y, CAST(q AS INT) AS x, {r4('v', 'v')} FROM {SQL['emb']} JOIN range(0, 5) a(p) ON y = CAST(floor((p + 0.5e0 - 1e-12) * 8 / 5) AS INT) JOIN range(0, 3) b(q) ON x = CAST(floor((q + 0.5e0 - 1e-12) * 8 / 3) AS INT)")
add("scale", lambda s, d: resample.scale(embedding_raster(s, d), 8, 8, 4, 2), f"SELECT image_id, CAST(y // 2 AS INT) AS y, CAST(x // 4 AS INT) AS x, {r4('avg(v)', 'v', 3)} FROM {SQL['emb']} GROUP BY image_id, y // 2, x // 4", 3)
add("distort_affine", lambda s, d: resample.distort(embedding_raster(s, d), 8, 8, *resample.affine(8, 8, 30.0, 1.2)))
add("distort_swirl", lambda s, d: resample.distort(embedding_raster(s, d), 8, 8, *resample.swirl(8, 8, 60.0)))
add("distort_implode", lambda s, d: resample.distort(embedding_raster(s, d), 8, 8, *resample.implode(8, 8, 0.5)))
add("distort_wave", lambda s, d: resample.distort(embedding_raster(s, d), 8, 8, *resample.wave(1.5, 6.0)), f"WITH g AS (SELECT image_id, y, x, y - 1.5e0 * sin(2 * pi() * x / 6e0) AS sy FROM {SQL['emb']}), t AS (SELECT *, floor(sy) + k AS iy FROM g, (VALUES (0), (1)) u(k)) SELECT t.image_id, t.y, t.x, {r4('sum((1 - abs(sy - iy)) * coalesce(e.v, 0))', 'v', 3)} FROM t LEFT JOIN {SQL['emb']} e ON e.image_id = t.image_id AND e.y = t.iy AND e.x = t.x GROUP BY t.image_id, t.y, t.x", 3)
_colored = [(1.0, 1.0, 10000.0), (6.0, 2.0, 50000.0), (3.0, 6.0, 30000.0)]
_d2 = [f"((x - {a}e0) * (x - {a}e0) + (y - {b}e0) * (y - {b}e0))" for a, b, _ in _colored]
for _name, _w in (("shepards", "{}"), ("inverse", "sqrt({})")):
    _ws = [f"(1e0 / greatest({_w.format(d)}, 1e-12))" for d in _d2]
    add(f"sparse_color_{_name}", lambda s, d, n=_name: resample.sparse_color(embedding_raster(s, d).select("image_id", "y", "x"), _colored, n), f"SELECT image_id, y, x, {r4('(' + ' + '.join(f'{w} * {p[2]}e0' for w, p in zip(_ws, _colored, strict=True)) + ') / (' + ' + '.join(_ws) + ')', 'v')} FROM {SQL['emb']}")
add("sparse_color_voronoi", lambda s, d: resample.sparse_color(embedding_raster(s, d).select("image_id", "y", "x"), _colored, "voronoi"), f"SELECT image_id, y, x, CASE WHEN {_d2[0]} <= {_d2[1]} AND {_d2[0]} <= {_d2[2]} THEN 10000e0 WHEN {_d2[1]} <= {_d2[2]} THEN 50000e0 ELSE 30000e0 END AS v FROM {SQL['emb']}")

# ---- regions and spectra -----------------------------------------------------------------------------------------
_edges = "WITH RECURSIVE p AS (SELECT image_id, y, x, v > 33000 AS k FROM " + SQL["emb"] + "), r(image_id, y, x, k, l) AS (SELECT image_id, y, x, k, y * 1048576 + x FROM p UNION SELECT p.image_id, p.y, p.x, p.k, r.l FROM r JOIN p ON p.image_id = r.image_id AND p.k = r.k AND abs(p.y - r.y) + abs(p.x - r.x) = 1), c AS (SELECT image_id, y, x, k, min(l) AS l FROM r GROUP BY image_id, y, x, k) "
add("connected_components", lambda s, d: regions.components(embedding_raster(s, d), "v > 33000"), _edges + "SELECT image_id, y, x, k AS value, CAST(l AS BIGINT) AS label FROM c")
add("connected_objects", lambda s, d: regions.objects(regions.components(embedding_raster(s, d), "v > 33000")), _edges + f"SELECT image_id, CAST(l AS BIGINT) AS label, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, {r4('avg(x)', 'cx')}, {r4('avg(y)', 'cy')} FROM c GROUP BY image_id, l")
add("floodfill", lambda s, d: regions.floodfill(embedding_raster(s, d), "v > 33000", 3, 4, 65535.0), _edges + f"SELECT e.image_id, e.y, e.x, {r4('CASE WHEN c.l = s.l THEN 65535e0 ELSE v END', 'v')} FROM {SQL['emb']} e JOIN c USING (image_id, y, x) JOIN (SELECT image_id, l FROM c WHERE y = 3 AND x = 4) s ON s.image_id = e.image_id")
add("hough_votes", lambda s, d: regions.hough(embedding_raster(s, d).where("v > 40000"), 18), f"SELECT image_id, CAST(t AS INT) AS theta, CAST(floor(round(x * cos(t * pi() / 18) + y * sin(t * pi() / 18), 9) + 0.5e0) AS INT) AS rho, count(*) AS votes FROM {SQL['emb']}, range(0, 18) r(t) WHERE v > 40000 GROUP BY ALL")
add("fourier", lambda s, d: regions.spectrum(embedding_raster(s, d)))
add("fourier_inverse", lambda s, d: regions.inverse_spectrum(regions.spectrum(embedding_raster(s, d))), f"SELECT image_id, y, x, {r4('v', 'v', 3)} FROM {SQL['emb']}", 3)

# ---- names, bytes ------------------------------------------------------------------------------------------------
add(
    "percent_escapes",
    lambda s, d: core.read(s, d, "documents").select(
        "doc_id",
        F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("n_chars").alias("size"), F.lit(8).alias("width"), F.lit(4).alias("height"), (F.col("doc_id") % 3).alias("scene"),
        F.lit(16).alias("depth"), F.col("lang").alias("format"), F.lit("c").alias("comment"), F.lit("l").alias("label"), F.lit(10).alias("delay"), F.lit(0).alias("x_offset"), F.lit(0).alias("y_offset"),
    ).select("doc_id", escapes.interpret("%d|%f|%t|%e|%wx%h+%s %m %b%%").alias("text")),
    "SELECT doc_id, '/data/' || source || '|' || doc_id || '.txt|' || doc_id || '|txt|8x4+' || (doc_id % 3) || ' ' || lang || ' ' || n_chars || 'B%' AS text FROM documents",
)
add("signature", lambda s, d: core.read(s, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("signature")), "SELECT page_id, sha256(html) AS signature FROM pages")
add("inline_base64", lambda s, d: core.read(s, d, "benchmark").select("item_id", F.concat(F.lit("data:text/plain;base64,"), F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", "")).alias("url")), "SELECT item_id, 'data:text/plain;base64,' || base64(encode(text)) AS url FROM benchmark")
for _kind, (_, _, _, _most) in codecs.FORMATS.items():  # every pixel through a file and back
    _v = "CASE WHEN v < 32767.5e0 THEN 0e0 ELSE 65535e0 END" if _most == 1 else "CAST(CAST(v / 65535e0 AS FLOAT) AS DOUBLE) * 65535e0" if not _most else f"floor(v / 65535e0 * {_most} + 0.5e0) / {_most}e0 * 65535e0"
    add(
        f"codec_{_kind}", lambda s, d, k=_kind: images.decode(images.encode(embedding_raster(s, d), k)).select("image_id", "y", "x", F.col("c0").alias("v")),
        f"SELECT image_id, y, x, {r4(_v, 'v', 0 if not _most else 4)} FROM {SQL['emb']}", 0 if not _most else 4,
    )

#: What the decoded samples of a gray image are, as SQL over v, where a format doesn't just round it.
_inverse = "65535e0 - floor((65535e0 - v) / 65535e0 * 255 + 0.5e0) / 255e0 * 65535e0"
_power = "pow(2e0, floor(log2(v / 65535e0)) - {})"
_decoded = {
    **dict.fromkeys(("c", "m", "y", "k"), "floor((65535e0 - v) / 65535e0 * 255 + 0.5e0) / 255e0 * 65535e0"), **dict.fromkeys(("cmyk", "cmyka"), _inverse), "a": "65535e0", "o": "0e0",
    **dict.fromkeys(("ycbcr", "ycbcra", "uyvy", "pal"), "greatest(0e0, least(65535e0, floor(v / 65535e0 * 255 + 0.5e0) / 255e0 * 65535e0 + 1.402e0 * (128e0 / 255e0 - 0.5e0) * 65535e0))"),
    "phm": f"round_even(v / 65535e0 / {_power.format(10)}, 0) * {_power.format(10)} * 65535e0", "hdr": f"floor(v / 65535e0 / {_power.format(7)}) * {_power.format(7)} * 65535e0",
}
for _kind in [*formats.MORE, *formats.ALIASES]:
    _name = formats.ALIASES.get(_kind, _kind)
    _most = (formats.MORE if _name in formats.MORE else codecs.FORMATS)[_name][3]
    _v = _decoded.get(_kind) or ("CASE WHEN v < 32767.5e0 THEN 0e0 ELSE 65535e0 END" if _most == 1 else f"floor(v / 65535e0 * {_most} + 0.5e0) / {_most}e0 * 65535e0")
    add(f"codec_{_kind}", lambda s, d, k=_kind: images.decode(images.encode(embedding_raster(s, d), k)).select("image_id", "y", "x", F.col("c0").alias("v")), f"SELECT image_id, y, x, {r4(_v, 'v')} FROM {SQL['emb']}")

# ---- effects -----------------------------------------------------------------------------------------------------
for _name, _f in effects.WHOLE.items():
    add(f"effect_{_name}", lambda s, d, f=_f: effects.whole(embedding_raster(s, d), f))
for _name in ("uniform", "gaussian", "multiplicative", "laplacian", "impulse", "poisson", "random"):
    add(f"noise_{_name}", lambda s, d, n=_name: effects.noise(embedding_raster(s, d), n))
add("spread", lambda s, d: effects.spread(embedding_raster(s, d)))
add("charcoal", lambda s, d: effects.charcoal(embedding_raster(s, d)))
add("gradient_linear", lambda s, d: effects.gradient(embedding_raster(s, d)), f"SELECT image_id, y, x, {r4('65535e0 * y / 7', 'v')} FROM {SQL['emb']}")
_out = "sqrt(pow((x - 3.5e0) / 4, 2) + pow((y - 3.5e0) / 4, 2))"
add("gradient_radial", lambda s, d: effects.gradient(embedding_raster(s, d), True), f"SELECT image_id, y, x, {r4(f'65535e0 * greatest(1 - {_out}, 0)', 'v')} FROM {SQL['emb']}")
add("vignette", lambda s, d: effects.vignette(embedding_raster(s, d)), f"SELECT image_id, y, x, {r4(f'v * least(greatest((1.5e0 - {_out}) / 1e0, 0), 1)', 'v')} FROM {SQL['emb']}")
for _name, (_rows, _div) in effects.DITHERS.items():
    _list = ", ".join(str(t) for row in _rows for t in row)
    add(f"dither_{_name}", lambda s, d, n=_name: effects.ordered_dither(embedding_raster(s, d), n), f"SELECT image_id, y, x, CASE WHEN v / 65535e0 > ([{_list}])[y % {len(_rows)} * {len(_rows)} + x % {len(_rows)} + 1] / {_div}e0 THEN 65535e0 ELSE 0e0 END AS v FROM {SQL['emb']}")
add("clut", lambda s, d: effects.clut(embedding_raster(s, d), [0, 30000, 20000, 65535]), f"SELECT image_id, y, x, {r4('([0e0, 30000e0, 20000e0, 65535e0])[k + 1] + (v / 21845e0 - k) * (([0e0, 30000e0, 20000e0, 65535e0])[k + 2] - ([0e0, 30000e0, 20000e0, 65535e0])[k + 1])', 'v')} FROM (SELECT *, CAST(least(floor(v / 21845e0), 2) AS INT) AS k FROM {SQL['emb']})")
add("stegano", lambda s, d: effects.stegano(embedding_raster(s, d), (F.col("x") + F.col("y")) % 2), f"SELECT image_id, y, x, floor(v / 2) * 2 + (x + y) % 2 + 0e0 AS v FROM {SQL['emb']}")
add("sepia", lambda s, d: unit_colours(s, d).select("image_id", "y", "x", *(c.alias(n) for n, c in zip(("c0", "c1", "c2"), effects.sepia(0.8), strict=True))), f"WITH t AS (SELECT *, 0.212656e0 * r + 0.715158e0 * g + 0.072186e0 * b AS i FROM {_unit}) SELECT image_id, y, x, {r4('CASE WHEN i > 0.8e0 THEN 1 ELSE i + 1 - 0.8e0 END', 'c0', 9)}, {r4('CASE WHEN i > 7e0 * 0.8e0 / 6 THEN 1 ELSE i + 1 - 7e0 * 0.8e0 / 6 END', 'c1', 9)}, {r4('CASE WHEN i < 0.8e0 / 6 THEN 0 ELSE i - 0.8e0 / 6 END', 'c2', 9)} FROM t", 9)
add("modulate", lambda s, d: effects.modulate(unit_colours(s, d), 90.0, 120.0, 130.0))
add(
    "magnify", lambda s, d: effects.magnify(embedding_raster(s, d).withColumn("v", F.floor(F.col("v") / 8192.0) * 8192.0)),
    f"""WITH e AS (SELECT image_id, y, x, floor(v / 8192e0) * 8192e0 AS v FROM {SQL['emb']}),
    q AS (SELECT p.image_id, p.y, p.x, p.v AS p, a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM e p JOIN e a ON a.image_id = p.image_id AND a.x = p.x AND a.y = greatest(p.y - 1, 0) JOIN e b ON b.image_id = p.image_id AND b.y = p.y AND b.x = least(p.x + 1, 7) JOIN e c ON c.image_id = p.image_id AND c.y = p.y AND c.x = greatest(p.x - 1, 0) JOIN e d ON d.image_id = p.image_id AND d.x = p.x AND d.y = least(p.y + 1, 7))
    SELECT image_id, y * 2 AS y, x * 2 AS x, CASE WHEN c = a AND c <> d AND a <> b THEN a ELSE p END AS v FROM q UNION ALL SELECT image_id, y * 2, x * 2 + 1, CASE WHEN a = b AND a <> c AND b <> d THEN b ELSE p END FROM q
    UNION ALL SELECT image_id, y * 2 + 1, x * 2, CASE WHEN d = c AND d <> b AND c <> a THEN c ELSE p END FROM q UNION ALL SELECT image_id, y * 2 + 1, x * 2 + 1, CASE WHEN b = d AND b <> a AND d <> c THEN d ELSE p END FROM q""",
)


# ---- lists, buffers, reports -------------------------------------------------------------------------------------
_fr = SQL["frames"]
add("list_append", lambda s, d: layers.append_list(frame_raster(s, d).where("scene < 2"), frame_raster(s, d).where("scene < 1")), f"SELECT image_id, scene, y, x, {r4('v', 'v')} FROM {_fr} WHERE scene < 2 UNION ALL SELECT f.image_id, CAST(f.scene + n AS INT), f.y, f.x, {r4('f.v', 'v')} FROM {_fr} f JOIN (SELECT image_id, max(scene) + 1 AS n FROM {_fr} WHERE scene < 2 GROUP BY image_id) USING (image_id) WHERE f.scene < 1")
add("list_insert", lambda s, d: layers.insert_frame(frame_raster(s, d), frame_raster(s, d).where("scene = 0").drop("scene"), 2), f"SELECT image_id, CAST(CASE WHEN scene >= 2 THEN scene + 1 ELSE scene END AS INT) AS scene, y, x, {r4('v', 'v')} FROM {_fr} UNION ALL SELECT image_id, 2, y, x, {r4('v', 'v')} FROM {_fr} WHERE scene = 0")
add("list_swap", lambda s, d: layers.swap_frames(frame_raster(s, d), 0, 3), f"SELECT image_id, CASE scene WHEN 0 THEN 3 WHEN 3 THEN 0 ELSE scene END AS scene, y, x, {r4('v', 'v')} FROM {_fr}")
add("export_import_pixels", lambda s, d: layers.import_pixels(layers.export_pixels(embedding_raster(s, d).withColumn("w", F.col("v") * 2), ("v", "w")), 8, ("v", "w")), f"SELECT image_id, y, x, {r4('v', 'v')}, {r4('v * 2', 'w')} FROM {SQL['emb']}")
add("stereo", lambda s, d: layers.stereo(*(embedding_raster(s, d).select("image_id", "y", "x", *((F.col("v") + k).alias(c) for c in "rgb")) for k in (0, 5))), f"SELECT image_id, y, x, {r4('v', 'r')}, {r4('v + 5', 'g')}, {r4('v + 5', 'b')} FROM {SQL['emb']}")
add("texture_tile", lambda s, d: layers.tiled(embedding_raster(s, d), embedding_raster(s, d).where("image_id = 0 and y < 3 and x < 2"), 3, 2), f"SELECT e.image_id, e.y, e.x, {r4('e.v', 'v')}, {r4('t.v', 't')} FROM {SQL['emb']} e JOIN {SQL['emb']} t ON t.image_id = 0 AND t.y = e.y % 3 AND t.x = e.x % 2")
add("identify_json", lambda s, d: stats.report(embedding_raster(s, d)), f"""SELECT image_id, '{{"width":8,"height":8,"min":' || CAST(round(min(v)) AS BIGINT) || ',"max":' || CAST(round(max(v)) AS BIGINT) || ',"mean":' || CAST(round(avg(v)) AS BIGINT) || '}}' AS json FROM {SQL['emb']} GROUP BY image_id""")
add("convex_hull", lambda s, d: stats.hull(embedding_raster(s, d).where("v > 38000")))
add("perceptual_hash", lambda s, d: stats.perceptual_hash(embedding_raster(s, d)))
add("best_offset", lambda s, d: metrics.best_offset(embedding_raster(s, d), embedding_raster(s, d).where("image_id = 3 and y between 2 and 4 and x between 1 and 3").withColumns({"y": F.col("y") - 2, "x": F.col("x") - 1})), f"WITH t AS (SELECT y - 2 AS ty, x - 1 AS tx, v AS t FROM {SQL['emb']} WHERE image_id = 3 AND y BETWEEN 2 AND 4 AND x BETWEEN 1 AND 3), o AS (SELECT image_id, y - ty AS y, x - tx AS x, avg(pow(v - t, 2)) AS error, count(*) AS n FROM {SQL['emb']}, t GROUP BY 1, 2, 3) SELECT image_id, (list(y ORDER BY error, y, x))[1] AS y, (list(x ORDER BY error, y, x))[1] AS x, {r4('min(error)', 'error', 2)} FROM o WHERE n = 9 GROUP BY image_id", 2)
add("linear_stretch", lambda s, d: transfer.linear_stretch(embedding_raster(s, d), 0.1, 0.1), _h + f", k AS (SELECT image_id, min(CASE WHEN below >= 0.1e0 * total THEN bin END) AS low, max(CASE WHEN total - below + n >= 0.1e0 * total THEN bin END) AS high FROM h GROUP BY image_id) SELECT image_id, y, x, {r4('CASE WHEN high > low THEN 65535e0 * (v - low * 257e0) / ((high - low) * 257e0) ELSE v END', 'v')} FROM e JOIN k USING (image_id)")
add("raise_edges", lambda s, d: geometry.raise_edges(embedding_raster(s, d), 2), f"SELECT image_id, y, x, {r4('CASE WHEN x < 2 OR y < 2 THEN (v * 190 + 65535e0 * 65) / 255e0 WHEN x >= 6 OR y >= 6 THEN v * 135 / 255e0 ELSE v END', 'v')} FROM {SQL['emb']}")

# ---- pixels outside and between; SQL written by hand from the rules, for rasters of 8 x 8 ------------------------------
_AXES = {"edge": "greatest(least({i}, 7), 0)", "tile": "{i} & 7", "mirror": "CASE WHEN {i} & 15 > 7 THEN 15 - ({i} & 15) ELSE {i} & 15 END", "dither": "greatest(least({i} + [0, 48, 12, 60, 3, 51, 15, 63][({i} & 7) + 1] - 32, 7), 0)", "own": "CASE WHEN {i} >= 0 AND {i} < 8 THEN {i} END"}
_RULES = {  # rule of rows, rule of columns
    "edge": ("edge", "edge"), "none": ("edge", "edge"), "tile": ("tile", "tile"), "mirror": ("mirror", "mirror"), "dither": ("dither", "dither"), "checker_tile": ("tile", "tile"), "horizontal_tile": ("own", "tile"), "horizontal_tile_edge": ("edge", "tile"), "vertical_tile": ("tile", "own"), "vertical_tile_edge": ("tile", "edge"),
    "background": ("own", "own"), "constant": ("own", "own"), "black": ("own", "own"), "gray": ("own", "own"), "white": ("own", "own"), "transparent": ("own", "own"),
}
_OUTSIDE = {"black": "0e0", "gray": "32767.5e0", "white": "65535e0", "transparent": "0e0"}
for _name, (_ry, _rx) in _RULES.items():
    _ny, _nx = (f"CASE WHEN y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 THEN {i} ELSE {_AXES[r].format(i=i)} END" for i, r in (("y", _ry), ("x", _rx)))
    if _name == "checker_tile":
        _ny = f"CASE WHEN (y & 8) = (x & 8) THEN {_ny} END"
    add(
        f"virtual_{_name}", lambda s, d, n=_name: virtual.view(embedding_raster(s, d), 5, -9, 12, 12, n, 700.0),
        f"WITH g AS (SELECT image_id, CAST(t.i AS INT) AS y, CAST(u.i AS INT) AS x FROM (SELECT DISTINCT vec_id AS image_id FROM embeddings), range(5, 17) t(i), range(-9, 3) u(i)), p AS (SELECT *, {_ny} AS ny, {_nx} AS nx FROM g) SELECT p.image_id, p.y, p.x, {r4(f'coalesce(e.v, {_OUTSIDE.get(_name, "700e0")})', 'v')}, CASE WHEN e.v IS NULL AND '{_name}' = 'transparent' THEN 0e0 ELSE 65535e0 END AS a FROM p LEFT JOIN {SQL['emb']} e ON e.image_id = p.image_id AND e.y = p.ny AND e.x = p.nx",
    )
add("virtual_random", lambda s, d: virtual.view(embedding_raster(s, d), 5, -9, 12, 12, "random"))


def _between(s: SparkSession, d: str) -> DataFrame:
    return embedding_raster(s, d).where("y < 5 and x < 5").select("image_id", "y", "x", (F.col("y") * 1.61 - 0.45).alias("py"), (F.col("x") * 1.37 - 0.3).alias("px"))


_third = "1e0 / 3"
_TAPS = {  # the first tap's place, and the weights from there on
    "integer": ("floor({p})", "1e0"), "nearest": ("floor({p} + 0.5e0)", "1e0"), "nearest_neighbor": ("floor({p} + 0.5e0)", "1e0"), "average": ("floor({p})", "0.5e0, 0.5e0"), "average4": ("floor({p})", "0.5e0, 0.5e0"), "average9": ("floor({p} + 0.5e0) - 1", f"{_third}, {_third}, {_third}"), "average16": ("floor({p}) - 1", "0.25e0, 0.25e0, 0.25e0, 0.25e0"),
    "bilinear": ("floor({p})", "1 - {f}, {f}"), "blend": ("floor({p})", "CASE WHEN {f} <= 0.25e0 THEN 1e0 WHEN {f} < 0.75e0 THEN 0.5e0 ELSE 0e0 END, CASE WHEN {f} <= 0.25e0 THEN 0e0 WHEN {f} < 0.75e0 THEN 0.5e0 ELSE 1e0 END"),
    "catrom": ("floor({p}) - 1", "-0.5e0 * {f} * (1 - {f}) * (1 - {f}), 1 + {f} * {f} * (1.5e0 * {f} - 2.5e0), {f} * (0.5e0 + {f} * (2 - 1.5e0 * {f})), 0.5e0 * {f} * {f} * ({f} - 1)"),
    "spline": ("floor({p}) - 1", "pow(1 - {f}, 3) / 6, 2e0 / 3 - {f} * {f} + pow({f}, 3) / 2, 1e0 / 6 + {f} / 2 + {f} * {f} / 2 - pow({f}, 3) / 2, pow({f}, 3) / 6"),
}
_points = f"p AS (SELECT image_id, y, x, py, px, py - floor(py) AS fy, px - floor(px) AS fx FROM (SELECT image_id, y, x, y * 1.61e0 - 0.45e0 AS py, x * 1.37e0 - 0.3e0 AS px FROM {SQL['emb']} WHERE y < 5 AND x < 5))"
for _name, (_first, _weights) in _TAPS.items():
    _n = _weights.count(",") + 1
    add(
        f"interpolate_{_name}", lambda s, d, n=_name: virtual.interpolate(embedding_raster(s, d), _between(s, d), n),
        f"WITH {_points}, t AS (SELECT p.image_id, p.y, p.x, ([{_weights.format(f='fy')}])[a.i + 1] * ([{_weights.format(f='fx')}])[b.i + 1] AS k, greatest(least({_first.format(p='py')} + a.i, 7), 0) AS ny, greatest(least({_first.format(p='px')} + b.i, 7), 0) AS nx FROM p, range({_n}) a(i), range({_n}) b(i)) SELECT t.image_id, t.y, t.x, {r4('sum(t.k * e.v)', 'v')} FROM t JOIN {SQL['emb']} e ON e.image_id = t.image_id AND e.y = t.ny AND e.x = t.nx GROUP BY ALL",
    )
_at = lambda i, j: f"(SELECT e.v FROM e WHERE e.image_id = p.image_id AND e.y = greatest(least(floor(py) + {i}, 7), 0) AND e.x = greatest(least(floor(px) + {j}, 7), 0))"
add("interpolate_mesh", lambda s, d: virtual.interpolate(embedding_raster(s, d), _between(s, d), "mesh"), f"WITH {_points}, e AS {SQL['emb']}, q AS (SELECT p.*, {_at(0, 0)} AS a, {_at(0, 1)} AS b, {_at(1, 0)} AS c, {_at(1, 1)} AS d FROM p) SELECT image_id, y, x, {r4('CASE WHEN abs(a - d) < abs(b - c) THEN CASE WHEN fx <= fy THEN (1 - fy) * a + (fy - fx) * c + fx * d ELSE (1 - fx) * a + (fx - fy) * b + fy * d END ELSE CASE WHEN fx + fy <= 1 THEN (1 - fx - fy) * a + fx * b + fy * c ELSE (fx + fy - 1) * d + (1 - fx) * c + (1 - fy) * b END END', 'v')} FROM q")
for _i, _name in enumerate(geometry.ORIENTATIONS):  # where the pixel at (y, x) goes
    _y, _x = (("y", "x"), ("y", "7 - x"), ("7 - y", "7 - x"), ("7 - y", "x"), ("x", "y"), ("x", "7 - y"), ("7 - x", "7 - y"), ("7 - x", "y"))[_i]
    add(f"orient_{_name}", lambda s, d, n=_name: geometry.upright(embedding_raster(s, d), n), f"SELECT image_id, CAST({_y} AS INT) AS y, CAST({_x} AS INT) AS x, {r4('v', 'v')} FROM {SQL['emb']}")
_LEFT, _TOP = {"west": 1, "": 3, "east": 4}, {"north": 2, "": 4, "south": 1}  # of a box of 3 x 5, moved by (1, 2)
for _name in (*geometry.GRAVITIES, "none", "forget"):
    _x0, _y0 = (1, 2) if _name in ("none", "forget") else (next(v for k, v in _LEFT.items() if k and _name.endswith(k)) if _name.endswith(("east", "west")) else 4, next(v for k, v in _TOP.items() if k and _name.startswith(k)) if _name.startswith(("north", "south")) else 4)
    add(f"gravity_{_name}", lambda s, d, n=_name: geometry.gravity_crop(embedding_raster(s, d), n, 3, 5, 1, 2), f"SELECT image_id, CAST(y - {_y0} AS INT) AS y, CAST(x - {_x0} AS INT) AS x, {r4('v', 'v')} FROM {SQL['emb']} WHERE x >= {_x0} AND x < {_x0 + 3} AND y >= {_y0} AND y < {_y0 + 5}")


# ---- alpha, channel selectors, masks, blends of colours ------------------------------------------------------------------
def _with_alpha(s: SparkSession, d: str) -> DataFrame:
    return order_raster(s, d).withColumn("a", F.when(F.col("image_id") % 2 == 0, 65535.0).otherwise(F.col("x") % 4 / 3.0 * 65535.0))


_rgba = f"(SELECT *, CASE WHEN image_id % 2 = 0 THEN 65535e0 ELSE x % 4 / 3e0 * 65535e0 END AS a FROM {SQL['ord']})"
_LUMINANCE = "0.212656e0 * r + 0.715158e0 * g + 0.072186e0 * b"
_BACK = {"r": "1000e0", "g": "30000e0", "b": "60000e0"}
_ALPHA_SQL = {  # of each colour c with the background k, and of alpha
    "on": ("{c}", "a"), "set": ("{c}", "a"), "activate": ("{c}", "a"), "discrete": ("{c}", "a"), "off": ("{c}", "65535e0"), "deactivate": ("{c}", "65535e0"), "opaque": ("{c}", "65535e0"), "transparent": ("{c}", "0e0"),
    "associate": ("{c} * a / 65535e0", "a"), "disassociate": ("CASE WHEN {c} = 0 THEN 0e0 WHEN a = 0 THEN 65535e0 ELSE least(65535e0, {c} / a * 65535e0) END", "65535e0"), "background": ("CASE WHEN a > 0 THEN {c} ELSE {k} END", "a"),
    "remove": ("({c} * a + {k} * (65535e0 - a)) / 65535e0", "65535e0"), "copy": ("{c}", _LUMINANCE), "extract": ("a", "65535e0"), "shape": ("{k}", _LUMINANCE), "off_if_opaque": ("{c}", "a"),
}
for _name, (_c, _a) in _ALPHA_SQL.items():
    add(f"alpha_{_name}", lambda s, d, n=_name: channels.alpha_mode(_with_alpha(s, d), n, (1000.0, 30000.0, 60000.0)), f"SELECT image_id, y, x, {', '.join(r4(_c.format(c=c, k=_BACK[c]), c) for c in 'rgb')}, {r4(_a, 'a')} FROM {_rgba}")
_SELECTORS = {  # what is negated
    "all": "rgba", "default": "rgba", "sync": "rgba", "red": "r", "r": "r", "cyan": "r", "c": "r", "gray": "r", "hue": "r", "h": "r", "0": "r", "green": "g", "g": "g", "magenta": "g", "m": "g", "chroma": "g", "saturation": "g", "s": "g", "1": "g", "blue": "b", "b": "b", "yellow": "b", "y": "b", "lightness": "b", "luminance": "b", "luminosity": "b", "l": "b", "2": "b",
    "alpha": "a", "a": "a", "matte": "a", "4": "a", "black": "", "k": "", "3": "", "meta": "", "readmask": "", "writemask": "", "5": "", "6": "", "7": "", "8": "", "9": "", "RGB": "rgb", "red,Blue": "rb", "RA": "ra",
}
for _name, _of in _SELECTORS.items():
    add(f"channel_select_{_name.replace(',', '_') if _name != _name.upper() or _name.isdigit() else _name + '_run'}", lambda s, d, n=_name: channels.apply(_with_alpha(s, d), n, lambda c: 65535.0 - c), f"SELECT image_id, y, x, {', '.join(r4(f'65535e0 - {c}' if c in _of else c, c) for c in 'rgba')} FROM {_rgba}")


def _masks(s: SparkSession, d: str) -> DataFrame:
    return embedding_raster(s, d).where("x <> 3").select("image_id", "y", "x", F.when((F.col("x") + F.col("y")) % 3 == 0, 20000.0).otherwise(50000.0).alias("mask"))


add("mask_write", lambda s, d: channels.write_masked(embedding_raster(s, d), embedding_raster(s, d).withColumn("v", 65535.0 - F.col("v")), _masks(s, d)), f"SELECT image_id, y, x, {r4('CASE WHEN x <> 3 AND (x + y) % 3 = 0 THEN v ELSE 65535e0 - v END', 'v')} FROM {SQL['emb']}")
add("mask_read", lambda s, d: channels.read_masked(embedding_raster(s, d), _masks(s, d)).groupBy("image_id").agg(F.count("v").alias("n"), F.avg("v").alias("mean")), f"SELECT image_id, count(*) AS n, {r4('avg(v)', 'mean')} FROM {SQL['emb']} WHERE x = 3 OR (x + y) % 3 <> 0 GROUP BY image_id")


def _colour_pairs(s: SparkSession, d: str, smooth: bool = False) -> DataFrame:
    """Each pixel over its right neighbour; every fifth source and every fourth canvas is transparent. Exponentials of the channels have no ties at the last digit that is compared."""
    one = unit_colours(s, d)
    if smooth:
        one = one.withColumns({c: F.exp(c) / 3.0 for c in "rgb"})
    source = one.select("image_id", "y", "x", *(F.col(c).alias(f"s{c}") for c in "rgb"), F.when(F.col("y") % 5 == 0, 0.0).otherwise(1.0).alias("sa"))
    return source.join(one.select("image_id", "y", (F.col("x") - 1).alias("x"), *(F.col(c).alias(f"d{c}") for c in "rgb"), F.when(F.col("y") % 4 == 0, 0.0).otherwise(1.0).alias("da")), ["image_id", "y", "x"])


_cp = f"(SELECT s.image_id, s.y, s.x, s.r AS sr, s.g AS sg, s.b AS sb, d.r AS dr, d.g AS dg, d.b AS db, CASE s.y % 5 WHEN 0 THEN 0e0 ELSE 1e0 END AS sa, CASE s.y % 4 WHEN 0 THEN 0e0 ELSE 1e0 END AS da FROM {_unit} s JOIN {_unit} d ON d.image_id = s.image_id AND d.y = s.y AND d.x = s.x + 1)"
_smooth = _cp.replace(_unit, f"(SELECT image_id, y, x, exp(r) / 3 AS r, exp(g) / 3 AS g, exp(b) / 3 AS b FROM {_unit})")
_six = lambda p: f"CASE WHEN {p}c = 0 THEN 0e0 WHEN {p}r >= {p}g AND {p}r >= {p}b THEN CASE WHEN {p}g >= {p}b THEN ({p}g - {p}b) / {p}c ELSE 6 + ({p}g - {p}b) / {p}c END WHEN {p}g >= {p}b THEN 2 + ({p}b - {p}r) / {p}c ELSE 4 + ({p}r - {p}g) / {p}c END"
_hcl = f"a AS (SELECT *, greatest(sr, sg, sb) - least(sr, sg, sb) AS sc, greatest(dr, dg, db) - least(dr, dg, db) AS dc FROM {_smooth}), b AS (SELECT *, {_six('s')} AS sh, {_six('d')} AS dh, 0.298839e0 * sr + 0.586811e0 * sg + 0.11435e0 * sb AS sl, 0.298839e0 * dr + 0.586811e0 * dg + 0.11435e0 * db AS dl, CAST(trunc((0.212656e0 * sr + 0.715158e0 * sg + 0.072186e0 * sb) * 65535e0 - 32768e0) AS BIGINT) AS step FROM a)"
_sector = lambda order: "CASE " + " ".join(f"WHEN h < {i + 1} THEN {o}" for i, o in enumerate(order[:5])) + f" ELSE {order[5]} END"
_prism = f"m AS (SELECT *, c * (1 - abs(h - 2 * floor(h / 2) - 1)) AS z FROM n), o AS (SELECT *, {_sector(('c', 'z', '0e0', '0e0', 'z', 'c'))} AS r0, {_sector(('z', 'c', 'c', 'z', '0e0', '0e0'))} AS g0, {_sector(('0e0', '0e0', 'z', 'c', 'c', 'z'))} AS b0 FROM m), q AS (SELECT *, l - 0.298839e0 * r0 - 0.586811e0 * g0 - 0.11435e0 * b0 AS up FROM o)"
for _name, _h, _c, _l in (("hue", "sh", "dc", "dl"), ("saturate", "dh", "sc", "dl"), ("luminize", "dh", "dc", "sl"), ("colorize", "sh", "sc", "dl"), ("modulate", "dh", "dc * 0.8e0", "dl + 0.9e0 * step / 32768e0")):
    _stays = "sa = 0 OR step = 0" if _name == "modulate" else "sa = 0"
    _alone = "" if _name == "modulate" else "WHEN da = 0 THEN s{c} "
    add(
        f"composite_{_name}", lambda s, d, n=_name: compose.composite_colour(_colour_pairs(s, d, True), n, 90.0, 80.0).select("image_id", "y", "x", "r", "g", "b", "a"),
        f"WITH {_hcl}, n AS (SELECT *, {_h} AS h, {_c} AS c, {_l} AS l FROM b), {_prism} SELECT image_id, y, x, {', '.join(r4(f'CASE WHEN {_stays} THEN d{c} {_alone.format(c=c)}ELSE {c}0 + up END', c, 9) for c in 'rgb')}, {'da' if _name == 'modulate' else 'greatest(sa, da)'} AS a FROM q", 9,
    )
for _name, _of in (("copy_red", "r"), ("copy_cyan", "r"), ("copy_green", "g"), ("copy_magenta", "g"), ("copy_blue", "b"), ("copy_yellow", "b")):
    add(f"composite_{_name}", lambda s, d, n=_name: compose.composite_colour(_colour_pairs(s, d), n).select("image_id", "y", "x", "r", "g", "b", "a"), f"SELECT image_id, y, x, {', '.join(r4(('s' if c == _of else 'd') + c, c, 9) for c in 'rgb')}, da AS a FROM {_cp}", 9)
_brighter = "0.212656e0 * sr + 0.715158e0 * sg + 0.072186e0 * sb > 0.212656e0 * dr + 0.715158e0 * dg + 0.072186e0 * db"
for _name, _made in (("lighten_intensity", f"CASE WHEN {_brighter} THEN s{{c}} ELSE d{{c}} END"), ("rmse", "sqrt(pow(sr - dr, 2) + pow(sg - dg, 2) + pow(sb - db, 2) / 3)")):
    add(f"composite_{_name}", lambda s, d, n=_name: compose.composite_colour(_colour_pairs(s, d), n).select("image_id", "y", "x", "r", "g", "b", "a"), f"SELECT image_id, y, x, {', '.join(r4('CASE WHEN sa = 0 THEN d' + c + ' WHEN da = 0 THEN s' + c + ' ELSE ' + _made.format(c=c) + ' END', c, 9) for c in 'rgb')}, greatest(sa, da) AS a FROM {_cp}", 9)
add("composite_change_mask", lambda s, d: compose.composite_colour(_colour_pairs(s, d), "change_mask").select("image_id", "y", "x", "r", "g", "b", "a"), f"SELECT image_id, y, x, {', '.join(r4('d' + c, c, 9) for c in 'rgb')}, CASE WHEN sr = dr AND sg = dg AND sb = db THEN 0e0 ELSE da END AS a FROM {_cp}", 9)


# ---- more shapes, kernels and patterns: SQL with the cells written out ---------------------------------------------------
_DRAWN = {  # around the middle
    "diamond": "..#..|.###.|#####|.###.|..#..", "disk": ".###.|#####|#####|#####|.###.", "octagon": ".###.|#####|#####|#####|.###.", "ring": ".###.|##.##|#...#|##.##|.###.",
}
for _shape, _art in _DRAWN.items():
    _cells = [(i - 2, j - 2, 1.0) for i, row in enumerate(_art.split("|")) for j, c in enumerate(row) if c == "#"]
    for _m, _agg in (("dilate", "max"), ("erode", "min")):
        add(f"morphology_{_m}_{_shape}", lambda s, d, m=_m, h=_shape: windows.morphology(embedding_raster(s, d), m, h), f"WITH e0 AS (SELECT * FROM {SQL['emb']}) SELECT image_id, y, x, {r4('v', 'v')} FROM {_morph('e0', _cells, _agg)}")
for _name, _k in {"unity": [[1.0]], "roberts": [[0.0, 0.0, 0.0], [1.0, -1.0, 0.0], [0.0, 0.0, 0.0]], "compass": [[1.0, 1.0, -1.0], [1.0, -2.0, -1.0], [1.0, 1.0, -1.0]], "freichen": [[1.0, 0.0, -1.0], [2.0**0.5, 0.0, -(2.0**0.5)], [1.0, 0.0, -1.0]]}.items():
    _mid = len(_k) // 2
    add(f"convolve_{_name}", lambda s, d, k=_k: windows.convolve(embedding_raster(s, d), k), f"SELECT image_id, y, x, {r4('sum(n * k)', 'v', 3)} FROM {_near([(_mid - i, _mid - j, c) for i, row in enumerate(_k) for j, c in enumerate(row) if c])} GROUP BY image_id, y, x", 3)
add("statistic_nonpeak", lambda s, d: windows.statistic(embedding_raster(s, d).withColumn("v", F.floor(F.col("v") / 8192.0) * 8192.0), "nonpeak"), f"WITH n AS (SELECT image_id, y, x, floor(n / 8192e0) * 8192e0 AS n FROM {_near(_box)}), m AS (SELECT image_id, y, x, (list(n ORDER BY n))[5] AS m, min(n) AS low, max(n) AS high FROM n GROUP BY image_id, y, x) SELECT image_id, y, x, CASE WHEN m = low AND m < high THEN min(n) FILTER (n > m) WHEN m = high AND m > low THEN max(n) FILTER (n < m) ELSE m END AS v FROM m JOIN n USING (image_id, y, x) GROUP BY image_id, y, x, m, low, high")


def _fits(source: str, on: str, off: str) -> str:
    """SQL of one pattern: lists of (dy, dx) that are set and unset."""
    side = lambda agg, cells: f"(SELECT e.image_id, e.y, e.x, {agg}(n.v) AS v FROM {source} e, (VALUES {cells}) o(dy, dx) JOIN {source} n ON n.image_id = e.image_id AND n.y = greatest(0, least(7, e.y + o.dy)) AND n.x = greatest(0, least(7, e.x + o.dx)) GROUP BY e.image_id, e.y, e.x)"
    return f"(SELECT image_id, p.y AS y, p.x AS x, greatest(0, p.v - q.v) AS v FROM {side('min', on)} p JOIN {side('max', off)} q USING (image_id, y, x))".replace("p.y AS y, p.x AS x", "y, x")


_RIDGE, _ENDS = ("(0, 0)", "(0, -1), (0, 1)"), ("(0, 0), (0, 1)", "(-1, -1), (-1, 0), (0, -1), (1, -1), (1, 0)")
_PATTERN_SQL = {"ridges": _RIDGE, "line_ends": _ENDS, "diagonals": ("(0, 1), (1, -1), (1, 0)", "(-1, -1), (-1, 0), (-1, 1), (0, -1)")}
for _name, (_on, _off) in _PATTERN_SQL.items():
    add(f"hit_and_miss_{_name}", lambda s, d, n=_name: windows.hit_and_miss(embedding_raster(s, d), [windows.PATTERNS[n]]), f"WITH e0 AS (SELECT * FROM {SQL['emb']}) SELECT image_id, y, x, {r4('v', 'v')} FROM {_fits('e0', _on, _off)}")
    for _m, _sign in (("thinning", "-"), ("thicken", "+")):
        add(f"morphology_{_m}_{_name}", lambda s, d, n=_name, m=_m: windows.thinned(embedding_raster(s, d), [windows.PATTERNS[n]], m == "thicken"), f"WITH e0 AS (SELECT * FROM {SQL['emb']}) SELECT image_id, y, x, {r4(f'e0.v {_sign} f.v', 'v')} FROM e0 JOIN {_fits('e0', _on, _off)} f USING (image_id, y, x)")
add("hit_and_miss_line_junctions", lambda s, d: windows.hit_and_miss(embedding_raster(s, d), [windows.PATTERNS["line_junctions"]]), f"WITH e0 AS (SELECT * FROM {SQL['emb']}) SELECT image_id, y, x, {r4('v', 'v')} FROM {_morph('e0', [(-1, -1, 1), (-1, 1, 1), (0, 0, 1), (1, 0, 1)], 'min')}")
add("hit_and_miss_ridges_turned", lambda s, d: windows.hit_and_miss(embedding_raster(s, d), windows.turned(windows.PATTERNS["ridges"])), f"WITH e0 AS (SELECT * FROM {SQL['emb']}) SELECT image_id, y, x, {r4('max(v)', 'v')} FROM ({' UNION ALL '.join('SELECT * FROM ' + _fits('e0', '(0, 0)', o) for o in ('(0, -1), (0, 1)', '(-1, 0), (1, 0)'))}) GROUP BY image_id, y, x")
_three = f"(SELECT image_id, y, x, v AS r, 65535e0 - v / 2 AS g, x * 9000e0 AS b FROM {SQL['emb']})"


def _by_luma(source: str, up: bool) -> str:
    place = "e.y - o.i AND n.x = e.x - o.j" if up else "e.y + o.i AND n.x = e.x + o.j"
    edge = place.replace("n.x = ", "").split(" AND ")
    return f"(SELECT e.image_id, e.y, e.x, unnest({'max' if up else 'min'}({{'i': 0.212656e0 * n.r + 0.715158e0 * n.g + 0.072186e0 * n.b, 'r': n.r, 'g': n.g, 'b': n.b}})) FROM {source} e, (SELECT a.i - 1 AS i, c.i - 1 AS j FROM range(3) a(i), range(3) c(i)) o JOIN {source} n ON n.image_id = e.image_id AND n.y = greatest(0, least(7, {edge[0]})) AND n.x = greatest(0, least(7, {edge[1]})) GROUP BY e.image_id, e.y, e.x)"


for _m, _sql in {"dilate": _by_luma(_three, True), "erode": _by_luma(_three, False), "open": _by_luma(_by_luma(_three, False), True), "close": _by_luma(_by_luma(_three, True), False)}.items():
    add(f"morphology_{_m}_intensity", lambda s, d, m=_m: windows.by_intensity(embedding_raster(s, d).select("image_id", "y", "x", F.col("v").alias("r"), (65535.0 - F.col("v") / 2).alias("g"), (F.col("x") * 9000.0).alias("b")), m), f"SELECT image_id, y, x, {', '.join(r4(c, c) for c in 'rgb')} FROM {_sql}")
