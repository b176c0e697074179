"""Percent escapes: a template over an image's properties, as one concatenation of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

def letters() -> dict[str, Column]:
    """Single-letter escapes over an ``images`` table: path, size, width, height, scene, depth, format, comment, label, delay, x_offset, y_offset."""
    path = F.col("path")
    file = F.element_at(F.split(path, "/"), -1)
    extension = F.when(file.contains("."), F.element_at(F.split(file, r"\."), -1)).otherwise("")
    return {
        "b": F.concat(F.col("size").cast("string"), F.lit("B")), "c": F.col("comment"), "d": F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "e": extension, "f": file, "h": F.col("height").cast("string"), "i": path,
        "l": F.col("label"), "m": F.col("format"), "p": F.col("scene").cast("string"), "q": F.lit("16"), "s": F.col("scene").cast("string"), "t": F.regexp_replace(file, r"\.[^.]*$", ""), "w": F.col("width").cast("string"), "z": F.col("depth").cast("string"),
        "B": F.col("size").cast("string"), "G": F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")), "O": F.concat(F.lit("+"), F.col("x_offset").cast("string"), F.lit("+"), F.col("y_offset").cast("string")),
        "P": F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")), "T": F.col("delay").cast("string"), "X": F.col("x_offset").cast("string"), "Y": F.col("y_offset").cast("string"), "%": F.lit("%"),
    }


NAMES = {"basename": "t", "directory": "d", "extension": "e", "height": "h", "width": "w", "input": "i", "scene": "s", "size": "B", "depth": "z", "page": "P"}


def interpret(template: str) -> Column:
    """The template with its escapes put in; an unknown escape stays as it is, a missing property is empty."""
    known = letters()
    parts: list[Column] = []
    for literal, name, letter in re.findall(r"([^%]+)|%\[([^\]]*)\]|%(.)", template):
        if literal:
            parts.append(F.lit(literal))
        elif name:
            parts.append(F.coalesce(known[NAMES[name]] if name in NAMES else F.col("properties").getItem(name), F.lit("")))
        else:
            parts.append(F.coalesce(known[letter], F.lit("")) if letter in known else F.lit(f"%{letter}"))
    return F.concat(*parts) if parts else F.lit("")
