"""Operators of scaffolding: each takes and returns DataFrames."""
