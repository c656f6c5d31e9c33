"""sources of the forecasting engine."""
