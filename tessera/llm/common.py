"""What the corpus operators share: reading tables, batch sizes, checked columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch on its way to a Python worker: a few long texts fill a batch
#: as surely as many short ones, so a worker's memory does not depend on text lengths.
ARROW_BATCH_BYTES = 16 * 1024 * 1024
ARROW_BATCH_ROWS = 2048

#: Prefix of columns that exist only inside an operator.
INNER = "_tessera_"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes and rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of a DataFrame by name, whatever signs the names have."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


#: Keys that may be called hot: those that hold over 1 in so many rows, so never more keys than this.
HOT_KEYS = 1000


def join_hot(rows: DataFrame, classes: DataFrame, key: str, class_key: str, size: str) -> DataFrame:
    """Rows with the one class of their key, every row having one, without a task for a frequent key.

    ``classes`` is a staged table with the number of rows of each key in ``size``. The at most
    ``HOT_KEYS`` frequent ones are broadcast, so their rows stay where they are.
    """
    total = classes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    frequent = F.col(size) * HOT_KEYS > total
    hot = F.broadcast(classes.where(frequent))
    named = F.col(key) == F.col(class_key)
    return rows.join(hot, named).unionByName(
        rows.join(F.broadcast(classes.where(frequent).select(class_key)), named, "left_anti").join(classes.where(~frequent), named)
    )
