"""tidepanel: batch analytics over daily entity panels, built on Spark DataFrames."""

__version__ = "0.1.0"
