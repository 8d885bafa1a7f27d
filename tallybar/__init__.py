"""tallybar: market bars and walk-forward cointegration on Spark DataFrames."""

__version__ = "0.1.0"
