"""Pages of an ordered table by their place, however deep.

``offset`` pulls all rows before a page through one task. Here the rows are sorted over all tasks and stored once, with the number of
rows before each file; a page then opens the one or two files that hold it and keeps its rows by their place in them, so every
task sees rows in proportion to a page and a file, never to the pages before.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.operators.ids import ordered_table, read_numbered

PLACE = "page_place"


@dataclass
class Pages:
    rows: DataFrame  # stored in order, without their place
    offsets: DataFrame  # for each file the rows before it

    def page(self, number: int, size: int) -> DataFrame:
        """The rows of page ``number`` (from 1; smaller numbers count as 1) in order; none behind the last page."""
        first = (max(int(number), 1) - 1) * size
        ends = self.offsets.withColumn("next", F.lead("__lf_off").over(Window.orderBy("__lf_off", "__lf_file")))  # one row per file
        holding = ends.where((F.col("__lf_file") != "") & (F.col("__lf_off") < first + size) & (F.col("next").isNull() | (F.col("next") > first)))
        files = [unquote(r["__lf_file"]) for r in holding.select("__lf_file").collect()]  # those that a page of rows touches
        if not files:
            return self.rows.limit(0)
        place = F.col(PLACE)
        found = read_numbered(self.rows.sparkSession.read.schema(self.rows.schema).parquet(*files), self.offsets, PLACE)
        return found.where((place > first) & (place <= first + size)).orderBy(place).select(*self.rows.columns)

    def total(self) -> int:
        """The number of rows, from the files' footers."""
        return self.rows.count()


def paged(df: DataFrame, order: list, num_partitions: int | None = None) -> Pages:
    """``df`` sorted by a total ``order`` and stored for paging, in ``num_partitions`` files or as many as its size asks for."""
    return Pages(*ordered_table(df, order, num_partitions=num_partitions))
