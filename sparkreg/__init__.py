"""Spark jobs for regression data with uncertainty: DataFrame in, DataFrame out."""
