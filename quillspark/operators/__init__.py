"""Operators: DataFrame -> DataFrame, each narrow or declared as the joins and aggregations it is."""
