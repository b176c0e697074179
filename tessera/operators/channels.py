"""Alpha modes, channel selectors and masks: projections of a pixel's channels. Columns r, g, b, a on the scale 0 to QR."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.core import EPSILON, QR

RGB = ("r", "g", "b")
#: What a name selects. The channel columns of other colour spaces stand in the same places.
NAMES = {
    "r": ("red", "r", "cyan", "c", "gray", "hue", "h", "0"),
    "g": ("green", "g", "magenta", "m", "chroma", "saturation", "s", "1"),
    "b": ("blue", "b", "yellow", "y", "lightness", "luminance", "luminosity", "l", "2"),
    "k": ("black", "k", "3"),
    "a": ("alpha", "a", "matte", "4"),
    "meta": ("meta", "5", "6", "7", "8", "9"),
    "read_mask": ("readmask",),
    "write_mask": ("writemask",),
}
_OF = {name: column for column, names in NAMES.items() for name in names}


def chosen(selector: str, columns: tuple[str, ...] = (*RGB, "a")) -> tuple[str, ...]:
    """The columns that a selector names, in the order of ``columns``: names with commas between them, or letters and digits in a row.

    ``all``, ``default`` and ``sync`` are all of them, the last for operators that treat them together.
    """
    picked: set[str] = set()
    for part in (p.strip().lower().replace("_", "") for p in selector.split(",")):
        if part in ("all", "default", "sync"):
            picked.update(columns)
        elif part in _OF:
            picked.add(_OF[part])
        elif part and all(c in _OF for c in part):
            picked.update(_OF[c] for c in part)
        else:
            raise ValueError(f"no channel {part!r}")
    return tuple(c for c in columns if c in picked)


def apply(df: DataFrame, selector: str, f: Callable[[Column], Column], columns: tuple[str, ...] = (*RGB, "a")) -> DataFrame:
    """``f`` of the selected channels; the others stay."""
    return df.withColumns({c: f(F.col(c)) for c in chosen(selector, columns)})


def intensity() -> Column:
    """Rec. 709 luma of r, g, b."""
    return 0.212656 * F.col("r") + 0.715158 * F.col("g") + 0.072186 * F.col("b")


def alpha_mode(df: DataFrame, mode: str, background: tuple[float, float, float] = (0.0, 0.0, 0.0), blended: bool = True, key: str = "image_id") -> DataFrame:
    """``df`` after a change of its alpha, with the alpha in effect: opaque where the image no longer blends.

    ``blended`` tells whether alpha was in effect before. ``associate`` multiplies colours by alpha, ``disassociate``
    divides; where alpha is next to 0 its reciprocal is 1e12, and colours end at QR. ``remove`` flattens over the
    background, ``background`` puts it where alpha is 0, ``shape`` paints it with the intensity as alpha,
    ``off_if_opaque`` looks at the whole image.
    """
    share, opaque = F.col("a") / QR, F.lit(QR)
    back = dict(zip(RGB, (F.lit(float(c)) for c in background), strict=True))
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(QR))
    if mode in ("off", "deactivate", "opaque"):
        return df.withColumn("a", opaque)
    if mode in ("on", "set", "discrete"):
        return df if blended else df.withColumn("a", opaque)
    if mode == "activate":
        return df
    if mode == "transparent":
        return df.withColumn("a", F.lit(0.0))
    if mode == "associate":
        return df.withColumns({c: clamp(F.col(c) * share) for c in RGB})
    if mode == "disassociate":
        part = F.when(share < EPSILON, 1.0 / EPSILON).otherwise(1.0 / share)
        return df.withColumns({c: clamp(F.col(c) * part) for c in RGB}).withColumn("a", opaque)
    if mode == "background":
        return df.withColumns({c: F.when(F.col("a") == 0, back[c]).otherwise(F.col(c)) for c in RGB}) if blended else df
    if mode == "remove":
        return df.withColumns({c: F.col(c) * share + back[c] * (1.0 - share) for c in RGB} | {"a": opaque}) if blended else df
    if mode == "copy":
        return df.withColumn("a", intensity())
    if mode == "extract":
        return df.withColumns({c: F.col("a") for c in RGB} | {"a": opaque})
    if mode == "shape":
        return df.withColumns(back | {"a": intensity()})
    if mode == "off_if_opaque":
        least = F.min("a").over(W.partitionBy(key))
        return df.withColumn("a", F.when(least >= QR, opaque).otherwise(F.col("a")))
    raise ValueError(f"no alpha mode {mode}")


ALPHA_MODES = ("on", "off", "activate", "deactivate", "set", "opaque", "transparent", "associate", "disassociate", "background", "remove", "copy", "extract", "shape", "discrete", "off_if_opaque")


def write_masked(before: DataFrame, after: DataFrame, masks: DataFrame, key: str = "image_id") -> DataFrame:
    """``after`` where the mask (key, y, x, mask) is over half of QR or has no pixel, else ``before``. Columns as those of ``before``."""
    place = [key, "y", "x"]
    rest = [c for c in before.columns if c not in place]
    both = before.join(after.select(*place, *(F.col(c).alias(f"__{c}") for c in rest)), place).join(masks.select(*place, "mask"), place, "left")
    free = F.coalesce(F.col("mask") > QR / 2, F.lit(True))
    return both.select(*place, *(F.when(free, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in rest))


def read_masked(df: DataFrame, masks: DataFrame, key: str = "image_id") -> DataFrame:
    """The pixels that statistics and comparisons read: those whose mask is over half of QR, or that have none."""
    place = [key, "y", "x"]
    return df.join(masks.select(*place, "mask"), place, "left").where(f"mask IS NULL OR mask > {QR / 2}D").drop("mask")
