"""A small corpus whose answers are arithmetic.

Fixed values (they have to equal the published test data): a 10 x 10 grid of places in the
unit square, six awkward ones, and the unit square with its four quadrants as polygons.
"""

from __future__ import annotations

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq

from tessera.functions import geometry as geo
from tessera.sources.catalog import Catalog, Source

RELEASE = "2026-01-01.0"
CATEGORIES = ("cafe", "park", "shop")
UNIT = {"min_lon": 0.0, "min_lat": 0.0, "max_lon": 1.0, "max_lat": 1.0}
CORNER = {"min_lon": 0.0, "min_lat": 0.0, "max_lon": 0.2, "max_lat": 0.2}
OUTLIERS = {"min_lon": 5.0, "min_lat": 5.0, "max_lon": 5.3, "max_lat": 5.1}

_BBOX = pa.struct([(m, pa.float64()) for m in ("xmin", "xmax", "ymin", "ymax")])
_PRIMARY = pa.struct([("primary", pa.string())])
_ADDRESS = pa.list_(pa.struct([("freeform", pa.string()), ("locality", pa.string()), ("country", pa.string())]))

PLACE_SCHEMA = pa.schema(
    [
        ("id", pa.string()),
        ("names", _PRIMARY),
        ("categories", _PRIMARY),
        ("confidence", pa.float64()),
        ("addresses", _ADDRESS),
        ("bbox", _BBOX),
        ("geometry", pa.binary()),
    ]
)
DIVISION_SCHEMA = pa.schema(
    [
        ("id", pa.string()),
        ("names", _PRIMARY),
        ("subtype", pa.string()),
        ("class", pa.string()),
        ("country", pa.string()),
        ("region", pa.string()),
        ("bbox", _BBOX),
        ("geometry", pa.binary()),
    ]
)

QUADRANTS = {
    "Alpha": (0.0, 0.0, 1.0, 1.0),
    "Southwest": (0.0, 0.0, 0.5, 0.5),
    "Southeast": (0.5, 0.0, 1.0, 0.5),
    "Northwest": (0.0, 0.5, 0.5, 1.0),
    "Northeast": (0.5, 0.5, 1.0, 1.0),
}


def place(id, lon, lat, name="Name", category="cafe", confidence=0.5, number=0):
    return {
        "id": id,
        "names": {"primary": name},
        "categories": {"primary": category},
        "confidence": confidence,
        "addresses": [{"freeform": f"Street {number}", "locality": "Gridtown", "country": "XX"}],
        "bbox": {"xmin": lon, "xmax": lon, "ymin": lat, "ymax": lat},
        "geometry": geo.to_wkb(geo.from_wkt(f"POINT ({lon} {lat})")),
    }


def grid():
    return [
        place(
            f"g{i:03d}",
            round(0.05 + 0.1 * (i // 10), 2),
            round(0.05 + 0.1 * (i % 10), 2),
            f"Place {i:02d}",
            CATEGORIES[i % 3],
            (i % 10 + 1) / 10,
            i,
        )
        for i in range(100)
    ]


def awkward():
    return [
        place("o0", 5.05, 5.05, name=None),
        place("o1", 5.15, 5.05, category=None, confidence=None),
        place("o2", 5.25, 5.05),
        place("w0", 179.95, 0.05),
        place("w1", -179.95, 0.05),
        place("n0", 0.05, 89.95),
    ]


def division(id, name, x0, y0, x1, y1):
    ring = f"{x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}"
    return {
        "id": id,
        "names": {"primary": name},
        "subtype": "region" if name == "Alpha" else "county",
        "class": "land",
        "country": "XX",
        "region": "XX-A",
        "bbox": {"xmin": x0, "xmax": x1, "ymin": y0, "ymax": y1},
        "geometry": geo.to_wkb(geo.from_wkt(f"POLYGON (({ring}))")),
    }


def write_part(folder, number, rows, schema, kind):
    os.makedirs(folder, exist_ok=True)
    document = {
        "version": "1.1.0",
        "primary_column": "geometry",
        "columns": {"geometry": {"encoding": "WKB", "geometry_types": [kind]}},
    }
    table = pa.Table.from_pylist(rows, schema=schema.with_metadata({"geo": json.dumps(document)}))
    pq.write_table(table, f"{folder}/part-{number:05d}.parquet")


def write(root):
    for number, rows in enumerate((grid(), awkward())):
        write_part(f"{root}/{RELEASE}/theme=places/type=place", number, rows, PLACE_SCHEMA, "Point")
    areas = [division(f"d{i}", name, *box) for i, (name, box) in enumerate(QUADRANTS.items())]
    write_part(f"{root}/{RELEASE}/theme=divisions/type=division_area", 0, areas, DIVISION_SCHEMA, "Polygon")


def catalog(root):
    return Catalog.of(
        RELEASE,
        Source(
            name="places",
            theme="places",
            type="place",
            root=root,
            attribution="nobody",
            category_column="categories.primary",
            confidence_column="confidence",
            default_columns=(
                "id",
                "names.primary AS name",
                "categories.primary AS category",
                "confidence",
                "addresses[1].freeform AS address",
                "bbox.xmin AS longitude",
                "bbox.ymin AS latitude",
            ),
            approximate_rows=100,
            approximate_bytes=1,
        ),
        Source(
            name="divisions",
            theme="divisions",
            type="division_area",
            root=root,
            category_column="subtype",
            polygonal=True,
            default_columns=("id", "names.primary AS name", "subtype"),
        ),
    )
