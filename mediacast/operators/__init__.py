"""operators of the forecasting engine."""
