"""The shape kernels over columns, in Arrow-batched maps."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from massif.config import EngineConfig
from massif.functions import overlay, shapes
from massif.functions.regions import Regions, apart, areas
from massif.operators import hierarchy


def shape_metrics(df: DataFrame) -> DataFrame:
    """object_id, length_m, width_m, azimuth_deg, circle_radius_m of each row's first ring."""
    kind = df.schema["object_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rings = [np.array([list(p) for p in r[0]], float) for r in batch["rings"]]
            rows = [(*shapes.metrics(r), shapes.circle(r)[2]) for r in rings]
            yield pd.DataFrame({"object_id": batch["object_id"], **dict(zip(("length_m", "width_m", "azimuth_deg", "circle_radius_m"), zip(*rows, strict=True), strict=True))} if rows else {c: [] for c in ("object_id", "length_m", "width_m", "azimuth_deg", "circle_radius_m")})

    return df.select("object_id", "rings").mapInPandas(run, f"object_id {kind}, length_m double, width_m double, azimuth_deg double, circle_radius_m double")


def regularized(parts: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """The rows with their ``rings`` regularised; a shell that can't be stays as it is."""
    c = config or EngineConfig()

    def run(batches):
        for batch in batches:
            out = []
            for rings in batch["rings"]:
                own = []
                for shell, *holes in shapes.polygons([np.array([list(p) for p in r], float) for r in rings]):
                    region, _ = shapes.regularize(shell, holes, circularity=c.circularity_threshold, rectangular=c.rectangular_ratio, tolerance=c.simplify_tolerance_m, min_hole=c.max_fill_hole_area_m2)
                    own += [r.tolist() for p in region for r in p]
                out.append(own)
            yield batch.assign(rings=out)

    return parts.mapInPandas(run, parts.schema)


def overlap(pairs: DataFrame) -> DataFrame:
    """The pairs with shared_m2, outside_m2 (of ``a``) and share: how much of the polygons ``a`` lies in ``b``, row by row."""
    keep = [c for c in pairs.columns if c not in ("a", "b")]

    def run(batches):
        for batch in batches:
            x, y = (Regions.of_column(batch.column(c)).united() for c in ("a", "b"))
            size = areas(np.ones(x.n, bool), [x], [lambda w: w[:, 0] % 2 == 1])[:, 0]
            met = ~apart(x, y)
            shared, outside = areas(met, [x, y], [lambda w: (w % 2 == 1).all(axis=1), lambda w: (w[:, 0] % 2 == 1) & (w[:, 1] % 2 == 0)]).T
            share = np.divide(shared, size, out=np.zeros(x.n), where=size > 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, (shared, np.where(met, outside, size), share))], names=[*keep, "shared_m2", "outside_m2", "share"])

    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep)
    return pairs.mapInArrow(run, f"{kinds}, shared_m2 double, outside_m2 double, share double")


def union(parts: DataFrame) -> DataFrame:
    """object_id, polygons: the union of each object's polygons; one object's shapes meet in one task."""
    kind = parts.schema["object_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        whole = overlay.union(*(overlay.repaired(hierarchy.opened(p)) for p in rows["polygons"]))
        return pd.DataFrame({"object_id": [rows["object_id"].iloc[0]], "polygons": [hierarchy.closed(whole)]})

    return parts.select("object_id", "polygons").groupBy("object_id").applyInPandas(run, f"object_id {kind}, polygons {hierarchy.SHAPE}")


def union_area(parts: DataFrame) -> DataFrame:
    """object_id, area_m2: the area that each object's polygons cover together; objects without area are left out."""
    from massif.operators.trees import region_area

    return union(parts).select("object_id", region_area("polygons").alias("area_m2")).filter("area_m2 > 0")


def polygons(parts: DataFrame) -> DataFrame:
    """The rows with ``polygons``: their rings as closed GeoJSON multipolygon coordinates."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in parts.schema)}, polygons array<array<array<array<double>>>>"

    def run(batches):
        for batch in batches:
            made = [[[[*r.tolist(), r[0].tolist()] for r in p] for p in shapes.polygons([np.array([list(q) for q in r], float) for r in rings])] for rings in batch["rings"]]
            yield batch.assign(polygons=made)

    return parts.mapInPandas(run, schema)
