"""Operators for training-data pipelines: each works on whole tables and whole texts."""
