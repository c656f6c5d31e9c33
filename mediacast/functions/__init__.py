"""functions of the forecasting engine."""
