"""cohortlens: longitudinal-panel and text-classification operators on Spark
DataFrames. Importing the package starts nothing."""

__version__ = "0.1.0"
