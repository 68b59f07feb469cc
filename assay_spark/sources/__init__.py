"""Sources and sinks."""

from assay_spark.sources.files import (
    read_wide, read_cells, read_matrix, write_cells, write_vectors, write_matrix, from_scores,
)

__all__ = ["read_wide", "read_cells", "read_matrix", "write_cells", "write_vectors", "write_matrix",
           "from_scores"]
