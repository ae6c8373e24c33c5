"""lexmill: text analytics and topic modelling on Spark DataFrames."""

__version__ = "0.1.0"
