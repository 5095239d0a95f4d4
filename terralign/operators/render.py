"""Tiles from a callable, as a table function that SQL can call along a grid of tiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType
from pyspark.sql.udtf import UserDefinedTableFunction

TILE = "row long, col long, x0 long, y0 long, width long, height long, rgba binary, is_empty boolean, skipped int"
GRID = ["row", "col", "x0", "y0", "x1", "y1"]


def tile_function(render: Callable) -> UserDefinedTableFunction:
    """A table function (row, col, x0, y0, x1, y1) -> TILE from render(x, y, width, height) -> (4, height, width) uint8.

    Arguments that aren't whole numbers are refused when a query is planned, images of another shape or type when it runs.
    Register it with spark.udtf.register, then: SELECT t.* FROM grid, LATERAL render_tile(row, col, x0, y0, x1, y1) t
    """

    schema = StructType.fromDDL(TILE)

    class RenderTile:
        @staticmethod
        def analyze(row, col, x0, y0, x1, y1):
            from pyspark.sql.udtf import AnalyzeResult

            for name, argument in zip(GRID, (row, col, x0, y0, x1, y1), strict=True):
                if not isinstance(argument.dataType, IntegralType):
                    raise ValueError(f"{name} must be a whole number, not {argument.dataType.simpleString()}")
            return AnalyzeResult(schema)

        def eval(self, row, col, x0, y0, x1, y1):
            import numpy as np

            w, h = x1 - x0, y1 - y0
            image = np.asarray(render(x0, y0, w, h))
            if image.shape != (4, h, w) or image.dtype != np.uint8:
                raise ValueError(f"the renderer returned {image.shape} {image.dtype}, expected {(4, h, w)} uint8")
            yield row, col, x0, y0, w, h, np.ascontiguousarray(image.transpose(1, 2, 0)).tobytes(), not bool(image[3].any()), 0

    return F.udtf(RenderTile)


def rendered(grid: DataFrame, render: Callable) -> DataFrame:
    """The tiles of a grid (GRID), rendered on executors."""
    asked = grid.select(*(F.col(c).cast("long").alias(f"at_{c}") for c in GRID))
    tiles = asked.lateralJoin(tile_function(render)(*(F.col(f"at_{c}").outer() for c in GRID)))
    return tiles.drop(*(f"at_{c}" for c in GRID))
