import struct
import zlib

import numpy as np
import pytest

from massif.config import EngineConfig, InputError
from massif.functions import projection
from massif.sources import geotiff
from massif.sources.grid import analysis_grid


def test_round_trip_of_windows(tmp_path):
    rng = np.random.default_rng(1)
    z = rng.normal(50, 9, (300, 410)).astype("f4")
    z[5:9, 7:12] = np.nan
    for compress in (True, False):
        path = str(tmp_path / f"{compress}.tif")
        geotiff.write(path, z, 770000.0, 9432000.0, 0.5, -0.5, 32750, nodata=-9999, tile=64, compress=compress)
        r = geotiff.Raster(path)
        assert (r.width, r.height, r.epsg, r.nodata, r.dx, r.dy) == (410, 300, 32750, -9999.0, 0.5, -0.5)
        assert r.bounds == (770000.0, 9431850.0, 770205.0, 9432000.0)
        assert np.array_equal(r.window(0, 0, 300, 410), z.astype(float), equal_nan=True)
        assert np.array_equal(r.window(60, 100, 70, 80), z[60:130, 100:180].astype(float), equal_nan=True)
        edge = r.window(-2, -3, 6, 6)
        assert np.isnan(edge[:2]).all() and np.array_equal(edge[2:, 3:], z[:4, :3].astype(float))


def strips(order, compression, predictor, z):
    """A file of strips by hand, with the named coding."""
    rows = 4
    data = []
    for at in range(0, len(z), rows):
        part = z[at : at + rows]
        if predictor == 3:
            planes = np.ascontiguousarray(part.astype(">f4")).view(np.uint8).reshape(len(part), -1, 4).transpose(0, 2, 1).reshape(len(part), -1)
            raw = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
        elif predictor == 2:
            raw = np.diff(part.astype("u2"), axis=1, prepend=np.uint16(0)).astype(order + "u2").tobytes()
        else:
            raw = part.astype(order + ("f4" if part.dtype.kind == "f" else "u2")).tobytes()
        data.append(zlib.compress(raw) if compression == 8 else raw)
    kind, bits = (3, 32) if z.dtype.kind == "f" else (1, 16)
    tags = [(256, "H", [z.shape[1]]), (257, "H", [len(z)]), (258, "H", [bits]), (259, "H", [compression]), (273, "I", [0] * len(data)), (278, "H", [rows]), (279, "I", [len(d) for d in data]), (317, "H", [predictor]), (339, "H", [kind]), (34264, "d", [2.0, 0, 0, 10, 0, -3.0, 0, 20, 0, 0, 0, 0, 0, 0, 0, 1]), (34735, "H", [1, 1, 0, 1, 2048, 0, 1, 4326])]
    at = 8 + 2 + 12 * len(tags) + 4
    for k, (t, letter, v) in enumerate(tags):
        if struct.calcsize(letter) * len(v) > 4:
            at += struct.calcsize(letter) * len(v)
    starts = [at + sum(map(len, data[:k])) for k in range(len(data))]
    head, extra, at = b"II" if order == "<" else b"MM", b"", 8 + 2 + 12 * len(tags) + 4
    head += struct.pack(order + "HIH", 42, 8, len(tags))
    for t, letter, v in tags:
        raw = struct.pack(f"{order}{len(v)}{letter}", *(starts if t == 273 else v))
        field = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(extra))
        extra += raw if len(raw) > 4 else b""
        head += struct.pack(order + "HHI", t, {"H": 3, "I": 4, "d": 12}[letter], len(v)) + field
    return head + b"\0\0\0\0" + extra + b"".join(data)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("compression", [1, 8])
@pytest.mark.parametrize("predictor", [1, 2, 3])
def test_other_codings(tmp_path, order, compression, predictor):
    rng = np.random.default_rng(2)
    z = rng.integers(0, 9000, (10, 13)).astype("u2") if predictor == 2 else rng.normal(0, 5, (10, 13)).astype("f4")
    path = tmp_path / "x.tif"
    path.write_bytes(strips(order, compression, predictor, z))
    r = geotiff.Raster(str(path))
    assert (r.x0, r.y0, r.dx, r.dy, r.epsg, r.nodata) == (10.0, 20.0, 2.0, -3.0, 4326, None)
    assert np.array_equal(r.window(0, 0, 10, 13), z.astype(float))


def test_lzw():
    codes = [256, 65, 66, 258, 260, 257]  # A, B, AB, ABA
    bits = "".join(f"{c:09b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    assert geotiff._lzw(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))) == b"ABABABA"


def test_bilinear_samples_share_missing_weights(tmp_path):
    z = np.add.outer(np.arange(6) * 3.0, np.arange(8) * 2.0)
    z[2, 3] = np.nan
    geotiff.write(str(tmp_path / "t.tif"), z, 0.0, 0.0, 1.0, -1.0, 32601, nodata=-1)
    r = geotiff.Raster(str(tmp_path / "t.tif"))
    x, y = np.array([1.25, 4.0, 3.4, -1.0, 0.1]), np.array([-1.75, -4.0, -2.4, -1.0, -0.1])
    got = r.sample(x, y)
    assert got[0] == pytest.approx(3 * 1.25 + 2 * 0.75) and got[1] == pytest.approx(3 * 3.5 + 2 * 3.5) and np.isnan(got[3]) and got[4] == pytest.approx(0)
    near = {(1, 2): 0.1 * 0.1, (1, 3): 0.1 * 0.9, (2, 2): 0.9 * 0.1}
    assert got[2] == pytest.approx(sum(z[k] * w for k, w in near.items()) / sum(near.values()))


def test_projections_round_trip():
    lon, lat = np.array([117.0, 119.4, 116.0, 114.2]), np.array([0.0, -5.13, -0.001, -60.0])
    for number in (32750, 3857, 4326):
        x, y = projection.forward(number, lon, lat)
        a, b = projection.inverse(number, x, y)
        assert np.abs(a - lon).max() < 1e-11 and np.abs(b - lat).max() < 1e-11
    east, north = projection.forward(32632, [9.0], [48.0])
    assert east[0] == pytest.approx(500000) and north[0] == pytest.approx(5316300.2245, abs=1e-3)
    assert projection.code("urn:ogc:def:crs:EPSG::32750") == 32750 and projection.code("urn:ogc:def:crs:OGC:1.3:CRS84") == 4326
    for bad in ("", "EPSG:2", "EPSG:32661", None):
        with pytest.raises(InputError):
            projection.code(bad)


def test_grid_follows_the_surface(tmp_path):
    z = np.full((40, 60), 7.0)
    x, y = projection.forward(32750, 119.4, -5.1)
    geotiff.write(str(tmp_path / "dsm.tif"), z, float(x), float(y), 0.5, -0.5, 32750)
    geotiff.write(str(tmp_path / "dtm.tif"), z - 2, 119.399, -5.099, 1e-4, -1e-4, 4326)
    geotiff.write(str(tmp_path / "far.tif"), z, 10.0, 50.0, 1e-4, -1e-4, 4326)
    c = EngineConfig()
    g = analysis_grid(str(tmp_path / "dsm.tif"), str(tmp_path / "dtm.tif"), c)
    assert (g.width, g.height, g.warped, g.pixel_area) == (60, 40, False, 0.25)
    dsm, dtm = g.open().read(3, 4, 5, 6)
    assert (dsm == 7).all() and np.allclose(dtm, 5)
    assert g.span((float(x) + 5.1, float(y) - 3, float(x) + 6, float(y) - 1), 2) == (0, 8, 8, 6) and g.span((0, 0, 1, 1), 5) is None
    warped = analysis_grid(str(tmp_path / "dtm.tif"), str(tmp_path / "dtm.tif"), c)
    dsm, dtm = warped.open().read(warped.height // 2, warped.width // 2, 3, 3)
    assert warped.warped and np.allclose(dsm, 5) and abs(warped.dx - 11.0) < 0.2
    with pytest.raises(InputError, match="overlap"):
        analysis_grid(str(tmp_path / "dsm.tif"), str(tmp_path / "far.tif"), c)
    (tmp_path / "no.tif").write_bytes(b"nothing here")
    for bad in (str(tmp_path / "no.tif"), str(tmp_path / "missing.tif"), ""):
        with pytest.raises(InputError):
            analysis_grid(bad, str(tmp_path / "dtm.tif"), c)
    with pytest.raises(InputError, match="drivers"):
        analysis_grid(str(tmp_path / "dsm.tif"), str(tmp_path / "dtm.tif"), EngineConfig(raster_drivers=("PNG", "GTiff")))
