"""The analysis grid: the surface raster's own cells in the working system, with terrain sampled onto them."""

import math
from dataclasses import dataclass

import numpy as np

from massif.config import EngineConfig, InputError
from massif.functions import projection
from massif.sources.geotiff import Raster, check_drivers

#: Rows and columns between exact reprojections of a window.
STEP = 16


@dataclass(frozen=True)
class Grid:
    """Where the grid lies; small, so that every task has it.  ``open`` gives a reader of windows."""

    dsm: str
    dtm: str
    epsg: int
    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int
    warped: bool
    tile: tuple[int, int]

    def open(self) -> "Reader":
        return Reader(self)

    @property
    def pixel_area(self) -> float:
        return abs(self.dx * self.dy)

    def span(self, box: tuple[float, float, float, float], pad: int) -> tuple[int, int, int, int] | None:
        """row, col, height, width of the cells that a box touches and ``pad`` more on each side, within the grid; None outside."""
        c = sorted(((box[0] - self.x0) / self.dx, (box[2] - self.x0) / self.dx))
        r = sorted(((box[1] - self.y0) / self.dy, (box[3] - self.y0) / self.dy))
        left, right = max(0, math.floor(c[0] + 1e-6) - pad), min(self.width, math.ceil(c[1] - 1e-6) + pad)
        top, bottom = max(0, math.floor(r[0] + 1e-6) - pad), min(self.height, math.ceil(r[1] - 1e-6) + pad)
        return (top, left, bottom - top, right - left) if top < bottom and left < right else None

    def cells(self, region, row: int, col: int):
        """A region in [col, row] coordinates of a window."""
        return [[(np.asarray(r, float) - (self.x0, self.y0)) / (self.dx, self.dy) - (col, row) for r in p] for p in region]

    def world(self, region, row: int, col: int):
        return [[(np.asarray(r, float) + (col, row)) * (self.dx, self.dy) + (self.x0, self.y0) for r in p] for p in region]


class Reader:
    def __init__(self, grid: Grid):
        self.grid, self.dsm, self.dtm = grid, Raster(grid.dsm), Raster(grid.dtm)

    def read(self, row: int, col: int, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Surface and terrain of a window, NaN where there is none."""
        g = self.grid
        at = lambda raster: raster.sample(*self._places(raster.epsg, row, col, height, width))
        return at(self.dsm) if g.warped else self.dsm.window(row, col, height, width), at(self.dtm)

    def _places(self, epsg: int, row: int, col: int, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The cells' middles in another system: exact for every STEP-th row and column, linear between them (an error far below a cell)."""
        g = self.grid
        rows, cols = (np.minimum(np.arange(0, n + STEP - 1, STEP), n - 1) if n > 1 else np.zeros(1, int) for n in (height, width))
        x, y = np.meshgrid(g.x0 + (col + cols + 0.5) * g.dx, g.y0 + (row + rows + 0.5) * g.dy)
        down, across = _between(rows, height), _between(cols, width)
        return tuple(_blend(_blend(z, *down).T, *across).T for z in projection.between(g.epsg, epsg, x, y))


def _between(nodes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place below n the nodes around it and the share of the second."""
    i = np.clip(np.searchsorted(nodes, np.arange(n), "right") - 1, 0, max(0, len(nodes) - 2))
    j = np.minimum(i + 1, len(nodes) - 1)
    return i, j, (np.arange(n) - nodes[i]) / np.maximum(nodes[j] - nodes[i], 1)


def _blend(z: np.ndarray, i: np.ndarray, j: np.ndarray, share: np.ndarray) -> np.ndarray:
    return z[i] + (z[j] - z[i]) * share[:, None]


def _box(raster: Raster, epsg: int, steps: int = 21) -> tuple[float, float, float, float]:
    """A raster's bounds in another system, along points of its edges."""
    low_x, low_y, high_x, high_y = raster.bounds
    t = np.linspace(0, 1, steps)
    x = np.concatenate([low_x + (high_x - low_x) * t, low_x + (high_x - low_x) * t, np.full(steps, low_x), np.full(steps, high_x)])
    y = np.concatenate([np.full(steps, low_y), np.full(steps, high_y), low_y + (high_y - low_y) * t, low_y + (high_y - low_y) * t])
    u, v = projection.between(raster.epsg, epsg, x, y)
    return float(u.min()), float(v.min()), float(u.max()), float(v.max())


def analysis_grid(dsm_path: str, dtm_path: str, config: EngineConfig) -> Grid:
    """The grid of two rasters: headers are read, cells aren't.

    A surface that is in the working system already keeps its cells; another one is laid out anew at its
    own resolution.  Rasters that don't overlap are an input error.
    """
    check_drivers(config.raster_drivers)
    epsg = projection.code(config.working_crs)
    if not dtm_path:
        raise InputError("a terrain raster (DTM) is needed")
    if not dsm_path:
        raise InputError("a surface raster (DSM) is needed")
    dtm, dsm = Raster(dtm_path), Raster(dsm_path)
    if dsm.epsg == epsg:
        place = dsm.x0, dsm.y0, dsm.dx, dsm.dy, dsm.width, dsm.height
    else:
        low_x, low_y, high_x, high_y = _box(dsm, epsg)
        side = math.hypot(high_x - low_x, high_y - low_y) / math.hypot(dsm.width, dsm.height)
        place = low_x, high_y, side, -side, math.ceil((high_x - low_x) / side), math.ceil((high_y - low_y) / side)
    tile = dsm.block if dsm.tiled else (256, 256)
    grid = Grid(dsm_path, dtm_path, epsg, *place, dsm.epsg != epsg, tile)
    box = _box(dtm, epsg)
    if grid.span(box, 0) is None:
        raise InputError("the surface and the terrain don't overlap")
    return grid
