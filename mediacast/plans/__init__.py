"""plans of the forecasting engine."""
