"""The closed set of datasets an engine may read.

Operations take a dataset *name*; the catalogue alone turns a name into a DataFrame, so no
argument can point a read anywhere else. A catalogue can be narrowed, never widened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InvalidRequestError, ScopeViolationError, UnknownSourceError


@dataclass(frozen=True)
class Source:
    """One dataset: where its Parquet parts are and which column plays which role.

    Parts lie in ``<root>/<release>/theme=<theme>/type=<type>/``. Instead of a root, a
    `view` may build the DataFrame from other tables.
    """

    name: str
    theme: str = ""
    type: str = ""
    root: str | None = None
    view: Callable[[SparkSession], DataFrame] | None = None
    title: str = ""
    description: str = ""
    license: str = ""
    attribution: str = ""
    notes: str = ""
    bbox_column: str = "bbox"
    # None when the bbox itself is the exact position (double members, points only).
    geometry_column: str | None = "geometry"
    name_column: str | None = "names.primary"
    category_column: str | None = None
    confidence_column: str | None = None
    polygonal: bool = False
    # "path" or "path AS alias", used when the caller names no columns.
    default_columns: tuple[str, ...] = ()
    approximate_rows: int | None = None
    approximate_bytes: int | None = None

    def prefix(self, release: str) -> str:
        if self.root is None:
            raise InvalidRequestError(f"dataset {self.name!r} is a view and has no files of its own")
        return f"{self.root}/{release}/theme={self.theme}/type={self.type}/"

    def role(self, column: str) -> str | None:
        """What a top-level column is for."""
        roles = (
            ("geometry", self.geometry_column),
            ("bbox", self.bbox_column),
            ("name", self.name_column),
            ("category", self.category_column),
            ("confidence", self.confidence_column),
        )
        return next((role for role, path in roles if path and path.split(".")[0] == column), None)


@dataclass(frozen=True)
class Catalog:
    """Datasets at one release. Immutable."""

    release: str
    sources: Mapping[str, Source] = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "sources", MappingProxyType(dict(self.sources)))

    @classmethod
    def of(cls, release: str, *sources: Source) -> Catalog:
        return cls(release, {source.name: source for source in sources})

    @property
    def names(self) -> list[str]:
        return sorted(self.sources)

    def get(self, name: str) -> Source:
        if name not in self.sources:
            raise UnknownSourceError(f"no dataset {name!r} here; available: {', '.join(self.names)}")
        return self.sources[name]

    def narrowed_to(self, names: Iterable[str]) -> Catalog:
        wanted = list(names)
        outside = sorted(set(wanted) - set(self.sources))
        if outside:
            raise ScopeViolationError(
                f"a catalogue can only be narrowed: {', '.join(outside)} is not among {', '.join(self.names)}"
            )
        return Catalog(self.release, {name: self.sources[name] for name in wanted})

    def path(self, name: str) -> str:
        return self.get(name).prefix(self.release)

    def dataframe(self, spark: SparkSession, name: str) -> DataFrame:
        """The dataset, lazily: a Parquet scan of all its parts, or its view."""
        source = self.get(name)
        return source.view(spark) if source.view else spark.read.parquet(source.prefix(self.release))

    def register_views(self, spark: SparkSession, names: Iterable[str] | None = None) -> list[str]:
        """Temp views for the named datasets (default: all that have a plain name)."""
        chosen = [n for n in (self.names if names is None else names) if n.isidentifier()]
        for name in chosen:
            self.dataframe(spark, name).createOrReplaceTempView(name)
        return chosen

    def entries(self, spark: SparkSession) -> DataFrame:
        """The catalogue as a table; reads nothing."""
        rows = [
            (
                s.name,
                s.title,
                s.description,
                s.license,
                s.attribution,
                self.release,
                s.bbox_column,
                s.geometry_column,
                s.name_column,
                s.category_column,
                s.polygonal,
                list(s.default_columns),
                s.approximate_rows,
                s.approximate_bytes,
                s.notes,
            )
            for s in self.sources.values()
        ]
        return spark.createDataFrame(rows, _ENTRY_SCHEMA)


_ENTRY_SCHEMA = (
    "name string, title string, description string, license string, attribution string, release string, "
    "bbox_column string, geometry_column string, name_column string, category_column string, "
    "polygonal boolean, default_columns array<string>, approximate_rows bigint, approximate_bytes bigint, "
    "notes string"
)


def schema_with_roles(df: DataFrame, source: Source) -> DataFrame:
    """``(position, column, type, role)`` of each top-level column; analysis only."""
    spark = df.sparkSession
    rows = [
        (i, f.name, f.dataType.simpleString(), source.role(f.name)) for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "position int, column string, type string, role string")


def with_bbox(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds the bbox struct of a point table that has plain coordinates."""
    x, y = F.col(lon).cast(T.DoubleType()), F.col(lat).cast(T.DoubleType())
    return df.withColumn(
        "bbox", F.struct(x.alias("xmin"), x.alias("xmax"), y.alias("ymin"), y.alias("ymax"))
    )


# The public map datasets (name, layout, roles, default columns, published
# sizes) a catalogue over them has to describe.
PUBLIC_ROOT = "s3a://overturemaps-us-west-2/release"
PUBLIC_RELEASE = "2026-08-19.0"


def public_maps(release: str = PUBLIC_RELEASE, root: str = PUBLIC_ROOT) -> Catalog:
    """Places, division areas and buildings of the open Overture Maps release."""
    return Catalog.of(
        release,
        Source(
            name="overture_places",
            theme="places",
            type="place",
            root=root,
            title="Places",
            description="Points of interest: name, category, confidence, address.",
            license="CDLA-Permissive-2.0",
            attribution="© Overture Maps Foundation",
            category_column="categories.primary",
            confidence_column="confidence",
            default_columns=(
                "id",
                "names.primary AS name",
                "categories.primary AS category",
                "confidence",
                "addresses[1].freeform AS address",
                "addresses[1].locality AS locality",
                "addresses[1].country AS country",
                "bbox.xmin AS longitude",
                "bbox.ymin AS latitude",
            ),
            approximate_rows=73_631_092,
            approximate_bytes=10_480_684_059,
        ),
        Source(
            name="overture_divisions",
            theme="divisions",
            type="division_area",
            root=root,
            title="Division areas",
            description="Administrative areas from country to locality.",
            license="ODbL, CDLA-Permissive-2.0",
            attribution="© Overture Maps Foundation",
            category_column="subtype",
            polygonal=True,
            default_columns=("id", "names.primary AS name", "subtype", "class", "country", "region"),
            approximate_rows=1_074_177,
            approximate_bytes=4_474_605_608,
        ),
        Source(
            name="overture_buildings",
            theme="buildings",
            type="building",
            root=root,
            title="Buildings",
            description="Building footprints with height and class where known.",
            license="ODbL, CDLA-Permissive-2.0",
            attribution="© Overture Maps Foundation",
            category_column="class",
            polygonal=True,
            default_columns=(
                "id",
                "names.primary AS name",
                "class",
                "height",
                "num_floors",
                "bbox.xmin AS longitude",
                "bbox.ymin AS latitude",
            ),
            approximate_bytes=277_419_729_506,
        ),
    )
