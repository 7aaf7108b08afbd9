"""GeoTIFF in and out: headers on the driver, blocks where they are needed, nodata and NaN as NaN.

Single-band files with strips or tiles, uncompressed, Deflate, LZW or Zstandard, with or without a
predictor, classic or BigTIFF.  ``Raster`` reads windows block by block and keeps a few blocks, so tasks
that work in tile order read each block about once.  Nothing else of a file is held.
"""

import math
import struct
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow.fs

from massif.config import InputError
from massif.functions import projection

DRIVERS, KEPT_BYTES = ("GTiff",), 64 << 20
#: TIFF field types: their struct letter (fixed values of the format).
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def file_system(path: str):
    """The file system and path of a local path or a URI."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def check_drivers(names: list[str] | tuple[str, ...] | None) -> None:
    """An allow-list must name exactly one driver that is here."""
    if names is not None and (len(names) != 1 or names[0] not in DRIVERS):
        raise InputError(f"raster_drivers must hold exactly one of {', '.join(DRIVERS)}, not {list(names)!r}")


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bit on, one code early."""
    table: list[bytes] = []
    out, bits, have, size, before = bytearray(), 0, 0, 9, b""
    for byte in data:
        bits, have = (bits << 8) | byte, have + 8
        if have < size:
            continue
        have -= size
        code, bits = bits >> have, bits & ((1 << have) - 1)
        if code == 257:
            break
        if code == 256:
            table, size, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before:
            table.append(before + entry[:1])
        before = entry
        size = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


class Raster:
    """One open file: width, height, x0, y0, dx, dy (north up), epsg, nodata; windows on demand."""

    def __init__(self, path: str):
        self.path = path
        try:
            system, place = file_system(path)
            self.file = system.open_input_file(place)
        except (OSError, ValueError) as e:
            raise InputError(f"{path} can't be read: {e}") from e
        self.blocks: OrderedDict[int, np.ndarray] = OrderedDict()
        try:
            self._header()
        except (struct.error, KeyError, IndexError, zlib.error) as e:
            raise InputError(f"{path} is no GeoTIFF that can be read: {e!r}") from e

    def _at(self, start: int, n: int) -> bytes:
        return self.file.read_at(n, start)

    def _header(self) -> None:
        head = self._at(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if not order or struct.unpack(order + "H", head[2:4])[0] not in (42, 43):
            raise InputError(f"{self.path} is no TIFF")
        big = struct.unpack(order + "H", head[2:4])[0] == 43
        at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        n = struct.unpack(order + ("Q" if big else "H"), self._at(at, 8 if big else 2))[0]
        size, word = (20, "Q") if big else (12, "I")
        body, tags = self._at(at + (8 if big else 2), n * size), {}
        for k in range(n):
            entry = body[k * size : (k + 1) * size]
            tag, kind, count = struct.unpack(order + "HH" + word, entry[: 12 if big else 8])
            if kind not in _TYPES:
                continue
            letter = _TYPES[kind]
            width = struct.calcsize("=" + letter) * count
            raw = entry[12 if big else 8 :]
            data = raw[:width] if width <= len(raw) else self._at(struct.unpack(order + word, raw)[0], width)
            tags[tag] = data.split(b"\0")[0].decode("latin-1") if letter == "s" else struct.unpack(order + letter * count if len(letter) > 1 else f"{order}{count}{letter}", data)
        one = lambda tag, default=None: tags[tag][0] if tag in tags else default
        self.width, self.height, self.order = one(256), one(257), order
        if one(277, 1) != 1:
            raise InputError(f"{self.path} has {one(277)} bands; one is needed")
        self.compression, self.predictor = one(259, 1), one(317, 1)
        kind = {1: "u", 2: "i", 3: "f"}[one(339, 1)]
        self.dtype = np.dtype(f"{order}{kind}{one(258, 1) // 8}")
        self.tiled = 322 in tags
        self.block = (one(323), one(322)) if self.tiled else (min(one(278, self.height), self.height), self.width)
        self.offsets, self.sizes = (tags[324], tags[325]) if self.tiled else (tags[273], tags[279])
        nodata = tags.get(42113, "").strip("\0 ")
        self.nodata = float(nodata) if nodata else None
        if 34264 in tags:
            t = tags[34264]
            if t[1] or t[4]:
                raise InputError(f"{self.path} is rotated")
            self.dx, self.x0, self.dy, self.y0 = t[0], t[3], t[5], t[7]
        elif 33550 in tags and 33922 in tags:
            sx, sy, *_ = tags[33550]
            i, j, _, x, y, *_ = tags[33922]
            self.dx, self.dy, self.x0, self.y0 = sx, -sy, x - i * sx, y + j * sy
        else:
            raise InputError(f"{self.path} isn't georeferenced")
        keys = tags.get(34735, ())
        geo = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        if geo.get(1025, 1) == 2:  # values are points: the tie is a pixel's middle
            self.x0, self.y0 = self.x0 - self.dx / 2, self.y0 - self.dy / 2
        number = geo.get(3072) or geo.get(2048)
        if not number:
            raise InputError(f"{self.path} names no coordinate system")
        self.epsg = projection.code(f"EPSG:{number}")

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        xs, ys = (self.x0, self.x0 + self.dx * self.width), (self.y0, self.y0 + self.dy * self.height)
        return min(xs), min(ys), max(xs), max(ys)

    def _decoded(self, k: int) -> np.ndarray:
        rows, cols = self.block
        if not self.sizes[k]:
            return np.full((rows, cols), np.nan)
        raw = self._at(self.offsets[k], self.sizes[k])
        if self.compression in (8, 32946):
            raw = zlib.decompress(raw)
        elif self.compression == 5:
            raw = _lzw(raw)
        elif self.compression == 50000:
            import zstandard

            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=rows * cols * self.dtype.itemsize)
        elif self.compression != 1:
            raise InputError(f"{self.path}: compression {self.compression} isn't known")
        if not self.tiled:
            rows = min(rows, self.height - k * rows)
        size = self.dtype.itemsize
        if self.predictor == 3:
            planes = np.cumsum(np.frombuffer(raw, np.uint8, rows * cols * size).reshape(rows, size * cols), axis=1, dtype=np.uint8).reshape(rows, size, cols)
            out = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, cols)
        else:
            out = np.frombuffer(raw, self.dtype, rows * cols).reshape(rows, cols)
            if self.predictor == 2:
                whole = out.view(f"{self.order}u{size}").astype(f"u{size}")
                out = np.cumsum(whole, axis=1, dtype=whole.dtype).view(self.dtype.newbyteorder("="))
        out = out.astype(float)
        return out if self.nodata is None or math.isnan(self.nodata) else np.where(out == self.nodata, np.nan, out)

    def _block(self, k: int) -> np.ndarray:
        if k in self.blocks:
            self.blocks.move_to_end(k)
            return self.blocks[k]
        self.blocks[k] = out = self._decoded(k)
        while len(self.blocks) > max(4, KEPT_BYTES // (8 * self.block[0] * self.block[1])):
            self.blocks.popitem(last=False)
        return out

    def window(self, row: int, col: int, height: int, width: int) -> np.ndarray:
        """The cells from (row, col) on; those outside the file are NaN."""
        out = np.full((height, width), np.nan)
        rows, cols = self.block
        across = -(-self.width // cols)
        for r in range(max(0, row) // rows, -(-min(self.height, row + height) // rows)):
            for c in range(max(0, col) // cols, -(-min(self.width, col + width) // cols)):
                block = self._block(r * across + c)[: self.height - r * rows, : self.width - c * cols]
                top, left = max(row, r * rows), max(col, c * cols)
                part = block[top - r * rows : row + height - r * rows, left - c * cols : col + width - c * cols]
                out[top - row : top - row + part.shape[0], left - col : left - col + part.shape[1]] = part
        return out

    def sample(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bilinear values at coordinates of the file's system: missing cells leave their weight to the others; NaN outside the file."""
        u, v = (x - self.x0) / self.dx - 0.5, (y - self.y0) / self.dy - 0.5
        within = (u >= -0.5) & (u <= self.width - 0.5) & (v >= -0.5) & (v <= self.height - 0.5)
        if not within.any():
            return np.full(x.shape, np.nan)
        c, r = np.floor(u), np.floor(v)
        left, top = int(c[within].min()), int(r[within].min())
        z = self.window(top, left, int(r[within].max()) - top + 2, int(c[within].max()) - left + 2)
        i, j = np.where(within, r - top, 0).astype(int), np.where(within, c - left, 0).astype(int)
        fu, fv = u - c, v - r
        total, weight = np.zeros(x.shape), np.zeros(x.shape)
        for a in (0, 1):
            for b in (0, 1):
                near, w = z[i + a, j + b], (fv if a else 1 - fv) * (fu if b else 1 - fu)
                seen = np.isfinite(near)
                total += np.where(seen, near, 0) * np.where(seen, w, 0)
                weight += np.where(seen, w, 0)
        return np.where(within & (weight > 1e-9), total / np.maximum(weight, 1e-9), np.nan)


def write(path: str, z: np.ndarray, x0: float, y0: float, dx: float, dy: float, epsg: int, nodata: float | None = None, tile: int = 256, compress: bool = True) -> None:
    """Write an array as a tiled, single-band GeoTIFF of 32-bit floats; NaN becomes ``nodata``."""
    z = np.asarray(z, "<f4")
    if nodata is not None:
        z = np.where(np.isnan(z), np.float32(nodata), z)
    height, width = z.shape
    system, place = file_system(path)
    keys = (1, 1, 0, 3, 1024, 0, 1, 2 if epsg == 4326 else 1, 1025, 0, 1, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg)
    down, across = -(-height // tile), -(-width // tile)
    n = down * across
    tags = [(256, "I", (width,)), (257, "I", (height,)), (258, "H", (32,)), (259, "H", (8 if compress else 1,)), (262, "H", (1,)), (277, "H", (1,)), (322, "H", (tile,)), (323, "H", (tile,)), (324, "I", (0,) * n), (325, "I", (0,) * n), (339, "H", (3,)), (33550, "d", (dx, -dy, 0.0)), (33922, "d", (0.0, 0.0, 0.0, x0, y0, 0.0)), (34735, "H", keys)]
    if nodata is not None:
        tags.append((42113, "s", f"{nodata:g}".encode() + b"\0"))
    kinds = {"s": 2, "H": 3, "I": 4, "d": 12}
    size = lambda t: len(t[2]) if t[1] == "s" else struct.calcsize("<" + t[1]) * len(t[2])
    at = 8 + 2 + 12 * len(tags) + 4
    places = {}
    for t in tags:
        if size(t) > 4:
            places[t[0]] = at
            at += size(t) + size(t) % 2
    starts, sizes, out = [], [], bytearray()
    for r in range(down):
        for c in range(across):
            block = np.zeros((tile, tile), "<f4")
            part = z[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile]
            block[: part.shape[0], : part.shape[1]] = part
            data = zlib.compress(block.tobytes(), 1) if compress else block.tobytes()
            starts.append(at + len(out))
            sizes.append(len(data))
            out += data
    if at + len(out) >= 1 << 32:
        raise ValueError("a classic TIFF holds at most 4 GB")
    tags = [(t, k, tuple(starts) if t == 324 else tuple(sizes) if t == 325 else v) for t, k, v in tags]
    head, extra = bytearray(struct.pack("<2sHIH", b"II", 42, 8, len(tags))), bytearray()
    for tag, letter, values in tags:
        data = values if letter == "s" else struct.pack(f"<{len(values)}{letter}", *values)
        head += struct.pack("<HHI", tag, kinds[letter], len(values)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", places[tag]))
        if len(data) > 4:
            extra += data + b"\0" * (len(data) % 2)
    with system.open_output_stream(place, compression=None) as f:
        f.write(bytes(head + b"\0\0\0\0" + extra + out))
