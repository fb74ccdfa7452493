"""Curriculum-graph analytics as PySpark DataFrame operators."""
