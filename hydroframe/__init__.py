"""Drought and climate indices over long-format DataFrames."""
