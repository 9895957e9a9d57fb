"""Column paths, projections and the attribute filters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InvalidRequestError, UnknownColumnError

_STEP = re.compile(r"(?P<field>[A-Za-z_][A-Za-z0-9_]*)(?:\[(?P<item>[1-9][0-9]*)\])?")


def column_path(path: str) -> Column:
    """``addresses[1].freeform`` as a Column: fields by dot, list items counted from 1.

    An item past the end of its list is NULL.
    """
    column: Column | None = None
    for text in path.split("."):
        step = _STEP.fullmatch(text)
        if step is None:
            raise InvalidRequestError(
                f"{path!r} is no column path; write a name ('confidence'), a nested "
                f"field ('categories.primary') or a list item counted from 1 ('addresses[1].freeform')"
            )
        field = step["field"]
        column = F.col(f"`{field}`") if column is None else column.getField(field)
        if step["item"]:
            column = F.try_element_at(column, F.lit(int(step["item"])))
    return column


def path_type(df: DataFrame, path: str) -> T.DataType:
    """The type of a path, by analysis alone: no data is read."""
    try:
        return df.select(column_path(path).alias("value")).schema[0].dataType
    except AnalysisException as exc:
        raise UnknownColumnError(
            f"column {path!r} does not exist here. Top-level columns: {', '.join(df.columns)}. "
            f"A nested field is written with a dot, as in 'categories.primary'."
        ) from exc


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def projection(df: DataFrame, columns: Sequence[str] | None, default: Sequence[str] = ()) -> list[Column]:
    """The columns asked for, each named by its full path, or the dataset's default
    ``path AS alias`` list, or everything."""
    if columns:
        for path in columns:
            path_type(df, path)
        return [column_path(path).alias(path) for path in columns]
    if default:
        chosen = []
        for item in default:
            path, _, alias = item.partition(" AS ")
            chosen.append(column_path(path.strip()).alias(alias.strip() or path.strip()))
        return chosen
    return [F.col(f"`{name}`") for name in df.columns]


def attribute_filters(
    category: str | None = None,
    name_contains: str | None = None,
    min_confidence: float | None = None,
    *,
    category_column: str | None = None,
    name_column: str | None = None,
    confidence_column: str | None = None,
) -> list[Column]:
    """Optional narrowing by category, name and confidence.

    Empty text means "no filter"; a confidence of 0.0 still drops NULLs. ``%`` and ``_``
    in `name_contains` keep their LIKE meaning, a backslash is an ordinary character.
    """
    wanted = []

    def require(column: str | None, role: str, argument: str) -> Column:
        if column is None:
            raise InvalidRequestError(f"the dataset has no {role} column, so {argument} cannot apply")
        return column_path(column)

    if category:
        wanted.append(require(category_column, "category", "category") == F.lit(category))
    if name_contains:
        pattern = "%" + name_contains.replace("\\", "\\\\") + "%"
        name = require(name_column, "name", "name_contains")
        wanted.append(F.like(F.lower(name), F.lower(F.lit(pattern))))
    if min_confidence is not None:
        if not 0.0 <= min_confidence <= 1.0:
            raise InvalidRequestError(f"min_confidence={min_confidence} is outside [0, 1]")
        confidence = require(confidence_column, "confidence", "min_confidence")
        wanted.append(confidence >= F.lit(float(min_confidence)))
    return wanted
