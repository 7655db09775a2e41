"""Ranking, retrieval and localization analytics as PySpark DataFrame operators."""
