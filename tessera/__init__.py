"""Spatial analytics on Spark over Parquet datasets with a geometry and a bbox column."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

from tessera.functions.boxes import BoundingBox
from tessera.sources.catalog import Catalog, Source, public_maps

__all__ = ["BoundingBox", "Catalog", "Source", "public_maps", "ship"]


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session, once.

    Not needed when the package is installed on the executors or passed with ``--py-files``.
    """
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="tessera-package-"), "tessera"),
        "zip",
        root_dir=os.path.dirname(here),
        base_dir=os.path.basename(here),
    )
    context.addPyFile(archive)
    context._tessera_shipped = True
