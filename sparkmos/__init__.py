"""Bias correction and verification of point forecasts, as Spark DataFrame plans."""
