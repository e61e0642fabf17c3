"""Nocturne: DataFrame operators for epoch-based biosignal and tabular analytics on Spark."""
