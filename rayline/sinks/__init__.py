"""Sinks: result files, text reports, annotated images."""
