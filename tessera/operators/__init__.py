"""Operators on panels: DataFrames with one row per entity and period."""
