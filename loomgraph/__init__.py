"""Property graphs and time series as DataFrames, compiled to Catalyst plans."""
