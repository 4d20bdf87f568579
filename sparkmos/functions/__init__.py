"""Scalar formulas as Column expressions; nothing here is a Python UDF."""
