"""Forecast evaluation on Spark: DataFrame operators over a forecast ledger and a quote archive."""
