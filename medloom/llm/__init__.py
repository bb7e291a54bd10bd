"""Operators of a training-data pipeline: fingerprints, dedup, decontamination, scoring, counting and packing."""
