"""A uniform grid over the extent of all boxes, and its postings."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrill.functions.boxes import Box, Columns

#: Fixed value: rows a cell that the automatic size aims at.
ROWS_A_CELL = 100
#: An extent below this has no width.
FLAT = 1e-9
#: Fixed value: the least positive float, which stands for a width of nothing.
NO_WIDTH = 1.17549435e-38


def _cells(low: float, high: float, n: int, at: Column) -> Column:
    """Column or row number of a coordinate; what lies outside goes to the edge."""
    width = max(high - low, NO_WIDTH)
    return F.least(F.greatest(F.floor((at - F.lit(low)) / F.lit(width) * F.lit(float(n))), F.lit(0)), F.lit(n - 1)).cast("int")


@dataclass(frozen=True)
class Grid:
    """``cols`` by ``rows`` cells over an extent, numbered row by row."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float
    cols: int
    rows: int

    @classmethod
    def sized(cls, extent: Box, n: int, rows_a_cell: int = ROWS_A_CELL) -> Grid:
        """About ``rows_a_cell`` rows a cell, cells nearly square."""
        wanted, width, height = max(n / rows_a_cell, 1.0), extent.xmax - extent.xmin, extent.ymax - extent.ymin
        cols = rows = 1
        if width >= FLAT and height >= FLAT:
            cols, rows = math.ceil(math.sqrt(wanted * width / height)), math.ceil(math.sqrt(wanted * height / width))
        elif width >= FLAT:
            cols = math.ceil(wanted)
        elif height >= FLAT:
            rows = math.ceil(wanted)
        return cls(extent.xmin, extent.ymin, extent.xmax, extent.ymax, max(1, cols), max(1, rows))

    @classmethod
    def of(cls, df: DataFrame, boxes: Columns | None = None, rows_a_cell: int = ROWS_A_CELL) -> Grid:
        """Sized by one aggregate over the non-empty boxes of ``df``."""
        at = boxes or Columns.named()
        r = df.where(~at.empty()).agg(*at.extent(), F.count("*").alias("n")).first()
        extent = Box(0.0, 0.0, 0.0, 0.0) if not r["n"] else Box(r["xmin"], r["ymin"], r["xmax"], r["ymax"])
        return cls.sized(extent, r["n"], rows_a_cell)

    @property
    def extent(self) -> Box:
        return Box(self.xmin, self.ymin, self.xmax, self.ymax)

    def asdict(self) -> dict:
        return asdict(self)

    def col(self, x: Column) -> Column:
        return _cells(self.xmin, self.xmax, self.cols, x)

    def row(self, y: Column) -> Column:
        return _cells(self.ymin, self.ymax, self.rows, y)

    def cell(self, col: Column, row: Column) -> Column:
        return row.cast("long") * self.cols + col

    def point_cell(self, x: Column, y: Column) -> Column:
        return self.cell(self.col(x), self.row(y))

    def span(self, box: Box) -> tuple[int, int, int, int]:
        """First and last column, first and last row that a query box reaches, computed as for rows."""

        def at(low: float, high: float, n: int, v: float) -> int:
            share = (v - low) / max(high - low, NO_WIDTH) * n
            return int(min(max(math.floor(share) if math.isfinite(share) else share, 0), n - 1))

        return (
            at(self.xmin, self.xmax, self.cols, box.xmin),
            at(self.xmin, self.xmax, self.cols, box.xmax),
            at(self.ymin, self.ymax, self.rows, box.ymin),
            at(self.ymin, self.ymax, self.rows, box.ymax),
        )

    def within(self, box: Box) -> Column:
        """True for postings in cells that the box reaches: ranges, not a list of cells."""
        if box.empty:
            return F.lit(False)
        c0, c1, r0, r1 = self.span(box)
        return F.col("col").between(c0, c1) & F.col("row").between(r0, r1)

    def postings(self, df: DataFrame, id: str, boxes: Columns | None = None) -> DataFrame:
        """(cell, col, row, id): every cell that a row's box reaches; empty boxes have none."""
        at = boxes or Columns.named()
        cols = F.explode(F.sequence(self.col(at.xmin), self.col(at.xmax))).alias("col")
        spans = df.where(~at.empty()).select(F.col(id).alias("id"), self.row(at.ymin).alias("r0"), self.row(at.ymax).alias("r1"), cols)
        return spans.select("id", "col", F.explode(F.sequence("r0", "r1")).alias("row")).select(self.cell(F.col("col"), F.col("row")).alias("cell"), "col", "row", "id")


def ids_in_box(postings: DataFrame, grid: Grid, box: Box) -> DataFrame:
    """Each row that some reached cell lists, once. A superset of those that overlap."""
    return postings.where(grid.within(box)).select("id").distinct()


def candidate_count(postings: DataFrame, grid: Grid, box: Box) -> DataFrame:
    """What routes a query: postings of the reached cells, a row once a cell (so more than rows)."""
    return postings.where(grid.within(box)).select("cell", "id").distinct().agg(F.count("*").alias("candidates"))


def seeds(postings: DataFrame, grid: Grid, box: Box, a_cell: int) -> DataFrame:
    """Rows that stand for their cells: all of a small cell, else ``a_cell`` at even steps."""
    w = Window.partitionBy("cell")
    ranked = postings.where(grid.within(box)).select("cell", "id").distinct()
    ranked = ranked.withColumn("at", F.row_number().over(w.orderBy("id")) - 1).withColumn("n", F.count("*").over(w))
    # Row at is the k-th step's if at = floor(k * n / a_cell) for some k.
    step = F.floor((F.col("at") * a_cell + F.col("n") - 1) / F.col("n"))
    even = (step < a_cell) & (F.floor(step * F.col("n") / a_cell) == F.col("at"))
    return ranked.where((F.col("n") <= a_cell) | even).select("id").distinct()


@dataclass(frozen=True)
class Partitioner:
    """A coarser grid by box centres, over an extent that is 1 % wider each way."""

    grid: Grid

    @classmethod
    def over(cls, extent: Box, partitions: int) -> Partitioner:
        width, height = max(extent.xmax - extent.xmin, 1e-6), max(extent.ymax - extent.ymin, 1e-6)
        dx, dy = (max(0.01 * (b - a), 1e-6) for a, b in ((extent.xmin, extent.xmax), (extent.ymin, extent.ymax)))
        cols, rows = (max(1, int(math.sqrt(x))) for x in (partitions * width / height, partitions * height / width))
        return cls(Grid(extent.xmin - dx, extent.ymin - dy, extent.xmax + dx, extent.ymax + dy, cols, rows))

    def partition(self, boxes: Columns) -> Column:
        return self.grid.point_cell((boxes.xmin + boxes.xmax) / 2, (boxes.ymin + boxes.ymax) / 2)

    def box(self, cell: int) -> Box:
        g, (row, col) = self.grid, divmod(cell, self.grid.cols)
        w, h = (g.xmax - g.xmin) / g.cols, (g.ymax - g.ymin) / g.rows
        return Box(g.xmin + col * w, g.ymin + row * h, g.xmin + (col + 1) * w, g.ymin + (row + 1) * h)

    def overlapping(self, query: Box) -> list[int]:
        c0, c1, r0, r1 = self.grid.span(query)
        found = ((row * self.grid.cols + col) for row in range(r0, r1 + 1) for col in range(c0, c1 + 1))
        return [k for k in found if not (b := self.box(k)).empty and b.xmin <= query.xmax and query.xmin <= b.xmax and b.ymin <= query.ymax and query.ymin <= b.ymax]


def partition_extents(df: DataFrame, partition: Column, boxes: Columns | None = None) -> DataFrame:
    """The extent of each partition's rows, which a query box is tested against."""
    return df.groupBy(partition.alias("partition")).agg(*(boxes or Columns.named()).extent(), F.count("*").alias("n"))
