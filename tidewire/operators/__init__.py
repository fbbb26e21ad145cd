"""Query operators; each takes streams or DataFrames and returns a DataFrame."""
