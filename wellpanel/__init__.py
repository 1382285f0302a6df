"""Monthly production panels on Spark: build, check, featurise, backtest, serve."""

__version__ = "0.1.0"
