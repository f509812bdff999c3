"""Panels built from tables, and the registered queries."""
