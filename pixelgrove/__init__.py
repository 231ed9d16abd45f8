"""Labelled records, pixel grids and frame streams on Spark: features, decision forests, tracking and posture scoring as DataFrames."""
