"""Audit operators: each is ``op(df, spec, by=()) -> DataFrame``."""
