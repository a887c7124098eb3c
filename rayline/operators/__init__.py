"""Operators over DataFrames: pairing, detection, lookups, evaluation, reports."""
