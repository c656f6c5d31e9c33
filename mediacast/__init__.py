"""Mediacast: probabilistic revenue and ad-return forecasting on PySpark."""
