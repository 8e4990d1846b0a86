"""Pricing operators; each takes and returns DataFrames."""
