"""stratafold: Bayesian segmentation of many ordered sequences, expressed with Spark DataFrames."""

__version__ = "0.3.0"
