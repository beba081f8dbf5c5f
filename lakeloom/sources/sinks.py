"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCATION = "struct<text:struct<page:int,paragraph:int>,timestamp:struct<start:double,stop:double>,spreadsheet:struct<column:string,row:int,sheet:string>>"


def embedding_rows(rows: DataFrame) -> DataFrame:
    """id, type, vector, text, blobref, location (JSON): the id falls back to a running number of its document."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("index")) - 1
    return rows.select(F.coalesce("id", place.cast("string")).alias("id"), "type", F.col("vector").cast("array<double>").alias("vector"), "text", "blobref", F.to_json("location").alias("location"))


def write_embeddings(rows: DataFrame, path: str) -> None:
    """Snappy Parquet; an empty table is refused."""
    out = embedding_rows(rows)
    if out.isEmpty():
        raise ValueError("no embeddings to write")
    out.write.option("compression", "snappy").parquet(path)


def read_location(text):
    """The JSON location as a struct; null where it can't be read."""
    return F.from_json(text, LOCATION)


def write_version(frame: DataFrame, root: str, version: int) -> str:
    """A table's next version beside the former ones; the caller switches to it once written."""
    path = f"{root.rstrip('/')}/v{version:08d}"
    frame.write.parquet(path)
    return path
