"""Transformations of DataFrames: packing, microbatches, collation, corruption, metrics, state, telemetry."""
