"""A small logical plan over rasters, with the rewrites that Catalyst can't infer.

Steps are functions of one sample (curves), neighbourhoods of a known reach, and crops. Before it becomes
DataFrame operations a plan moves crops towards the source, grown by the reach of the neighbourhoods they
pass, fuses neighbouring curves into one projection, and splits kernels of rank one into two passes.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import formula
from tessera.functions import pointwise
from tessera.operators import windows


@dataclass(frozen=True)
class Curve:
    """SQL of v."""

    sql: str


@dataclass(frozen=True)
class Kernel:
    weights: tuple[tuple[float, ...], ...]

    @property
    def reach(self) -> tuple[int, int]:
        return len(self.weights) // 2, len(self.weights[0]) // 2


@dataclass(frozen=True)
class Crop:
    """The pixels with y0 <= y < y1 and x0 <= x < x1; coordinates stay those of the whole image."""

    y0: int
    y1: int
    x0: int
    x1: int

    def grown(self, dy: int, dx: int) -> Crop:
        return Crop(self.y0 - dy, self.y1 + dy, self.x0 - dx, self.x1 + dx)


Step = Curve | Kernel | Crop


@dataclass(frozen=True)
class Plan:
    """Steps over images of one size."""

    height: int
    width: int
    steps: tuple[Step, ...] = field(default=())

    def curve(self, name: str, **constants: float) -> Plan:
        return self._then(Curve(formula(pointwise.CURVES[name], v="{v}", **constants)))

    def evaluate(self, op: str, c: float) -> Plan:
        return self._then(Curve(formula(pointwise.EVALUATE[op], v="{v}", c=c)))

    def convolve(self, weights: list[list[float]]) -> Plan:
        return self._then(Kernel(tuple(map(tuple, weights))))

    def crop(self, y: int, x: int, height: int, width: int) -> Plan:
        return self._then(Crop(y, y + height, x, x + width))

    def _then(self, step: Step) -> Plan:
        return replace(self, steps=(*self.steps, step))

    def optimized(self) -> Plan:
        return replace(self, steps=_fused(_separated(_cropped_early(self.steps))))

    def run(self, df: DataFrame, optimize: bool = True) -> DataFrame:
        for step in (self.optimized() if optimize else self).steps:
            if isinstance(step, Curve):
                df = df.withColumn("v", F.expr(step.sql.replace("{v}", "v")))
            elif isinstance(step, Crop):
                df = df.where(F.col("y").between(step.y0, step.y1 - 1) & F.col("x").between(step.x0, step.x1 - 1))
            else:
                df = self._convolved(df, step)
        return df

    def _convolved(self, df: DataFrame, kernel: Kernel) -> DataFrame:
        """Edges repeat the outermost pixel of the whole image; where a crop has taken it, what is left lies outside of the crop."""
        h, w = kernel.reach
        cells = [(h - i, w - j, k) for i, row in enumerate(kernel.weights) for j, k in enumerate(row) if k]
        taps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(k)).alias("k")) for dy, dx, k in cells))
        at = df.select("image_id", "y", "x", F.explode(taps).alias("c")).select(
            "image_id", "y", "x", F.col("c.k").alias("k"), F.expr(f"int(greatest(0, least({self.height - 1}, y + c.dy)))").alias("ny"), F.expr(f"int(greatest(0, least({self.width - 1}, x + c.dx)))").alias("nx")
        )
        there = df.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("v").alias("n"))
        return at.join(there, ["image_id", "ny", "nx"]).groupBy("image_id", "y", "x").agg(F.sum(F.col("n") * F.col("k")).alias("v"))


def _cropped_early(steps: tuple[Step, ...]) -> tuple[Step, ...]:
    """Each crop moves towards the source; through a neighbourhood a larger one goes ahead of it."""
    out: list[Step] = []
    for step in steps:
        if not isinstance(step, Crop):
            out.append(step)
            continue
        at, ahead = len(out), step
        if any(isinstance(s, Kernel) for s in out):
            out.append(step)
        while at and not isinstance(out[at - 1], Crop):
            if isinstance(out[at - 1], Kernel):
                ahead = ahead.grown(*out[at - 1].reach)
            at -= 1
        if at and isinstance(out[at - 1], Crop):
            b = out[at - 1]
            out[at - 1] = Crop(max(b.y0, ahead.y0), min(b.y1, ahead.y1), max(b.x0, ahead.x0), min(b.x1, ahead.x1))
        else:
            out.insert(at, ahead)
    return tuple(out)


def _separated(steps: tuple[Step, ...]) -> tuple[Step, ...]:
    out: list[Step] = []
    for step in steps:
        if isinstance(step, Kernel) and min(len(step.weights), len(step.weights[0])) > 1:
            u, s, v = np.linalg.svd(np.array(step.weights))
            if s[1:].max() < 1e-12 * s[0]:
                out += [Kernel((tuple(float(x) for x in v[0] * s[0]),)), Kernel(tuple((float(x),) for x in u[:, 0]))]
                continue
        out.append(step)
    return tuple(out)


def _fused(steps: tuple[Step, ...]) -> tuple[Step, ...]:
    out: list[Step] = []
    for step in steps:
        if isinstance(step, Curve) and out and isinstance(out[-1], Curve):
            inner = out.pop().sql
            step = Curve(step.sql.replace("{v}", f"({inner})")) if step.sql.count("{v}") == 1 else Curve(f"aggregate(array({inner}), double(0), (a, b) -> b, b -> {step.sql.replace('{v}', 'b')})")
        out.append(step)
    return tuple(out)


def gaussian_plan(height: int, width: int, radius: int, sigma: float) -> Plan:
    """A blur as one kernel of rank one, which the plan splits."""
    k = windows.gaussian(radius, sigma)
    return Plan(height, width).convolve([[a * b for b in k] for a in k])
