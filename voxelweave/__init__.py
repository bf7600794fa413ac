"""voxelweave: instance analytics over labelled 3-D volumes, on Spark DataFrames."""

__version__ = "0.1.0"
