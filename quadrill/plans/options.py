"""What an index is built with, and what a session searches with."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import SparkSession

from quadrill.functions.metrics import Metric

#: Limits of vectors and of their storage.
MOST_DIMENSIONS, MOST_PLAIN_DIMENSIONS, MOST_CHOSEN_DIMENSIONS = 16000, 2000, 5000
MOST_DIMENSIONS_OF_WIDE_CODES, TWO_BITS_BELOW = 930, 900
DEFAULT_NEIGHBORS = 50
LAYOUTS = {"plain": "plain", "memory_optimized": "memory_optimized", "bq_compression": "memory_optimized"}


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}, not {value}")


@dataclass(frozen=True)
class IndexOptions:
    """Options of an index; -1 or 0 leave a choice to ``resolved``."""

    metric: Metric = Metric.COSINE
    num_neighbors: int = -1
    search_list_size: int = 100
    max_alpha: float = 1.2
    num_dimensions: int = 0
    num_bits_per_dimension: int = 0
    storage_layout: str = "memory_optimized"

    def __post_init__(self):
        object.__setattr__(self, "metric", Metric.of(self.metric))
        if self.storage_layout not in LAYOUTS:
            raise ValueError(f"unknown storage layout {self.storage_layout!r}")
        object.__setattr__(self, "storage_layout", LAYOUTS[self.storage_layout])
        if self.num_neighbors != -1:
            _within("num_neighbors", self.num_neighbors, 10, 1000)
        _within("search_list_size", self.search_list_size, 10, 1000)
        _within("max_alpha", self.max_alpha, 1.0, 5.0)
        _within("num_dimensions", self.num_dimensions, 0, MOST_DIMENSIONS)
        _within("num_bits_per_dimension", self.num_bits_per_dimension, 0, 32)

    def resolved(self, dims: int, labels: bool = False) -> IndexOptions:
        """These options with every choice made, for vectors of ``dims`` components; errors where they can't hold them."""
        plain = self.storage_layout == "plain"
        if plain and self.metric is Metric.IP:
            raise ValueError("inner product needs the memory_optimized layout")
        if plain and labels:
            raise ValueError("labels need the memory_optimized layout")
        if dims < 1:
            raise ValueError("vectors must have components")
        _within("the number of components", dims, 1, MOST_PLAIN_DIMENSIONS if plain else MOST_DIMENSIONS)
        used = self.num_dimensions or dims
        if self.num_dimensions > MOST_CHOSEN_DIMENSIONS and self.num_dimensions != dims:
            raise ValueError(f"num_dimensions must be at most {MOST_CHOSEN_DIMENSIONS}, or all")
        if used > dims:
            raise ValueError(f"num_dimensions {used} is more than the {dims} that vectors have")
        bits = self.num_bits_per_dimension or (2 if not plain and used < TWO_BITS_BELOW else 1)
        if bits > 1 and (plain or used > MOST_DIMENSIONS_OF_WIDE_CODES):
            raise ValueError("more than one bit a component needs the memory_optimized layout and few components")
        neighbors = DEFAULT_NEIGHBORS if self.num_neighbors == -1 else self.num_neighbors
        return IndexOptions(self.metric, neighbors, self.search_list_size, self.max_alpha, used, bits, self.storage_layout)

    def asdict(self) -> dict:
        return asdict(self) | {"metric": self.metric.title}


#: Least and greatest of each setting.
RANGES = {
    "query_search_list_size": (1, 10_000),
    "query_rescore": (0, 1000),
    "spatial_brute_force_threshold": (0, 2**31 - 1),
    "spatial_seeds_per_cell": (1, 100),
    "spatial_overflow_compact_threshold": (1, 2**31 - 1),
}
CONF = "spark.quadrill."


@dataclass(frozen=True)
class Settings:
    """Settings of searches; ``of(spark)`` reads ``spark.quadrill.*`` of the session."""

    query_search_list_size: int = 100
    query_rescore: int = 0  # rows of nearest code that are ranked by their vectors; 0: all rows, exactly
    spatial_brute_force_threshold: int = 5000
    spatial_seeds_per_cell: int = 2
    spatial_overflow_compact_threshold: int = 10_000

    def __post_init__(self):
        for name, (low, high) in RANGES.items():
            _within(name, getattr(self, name), low, high)

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        given = {f.name: spark.conf.get(CONF + f.name, None) for f in fields(cls)}
        return cls(**{k: int(v) for k, v in given.items() if v is not None})
