"""Measurement, join, graph and report operators: DataFrame in, DataFrame out."""
