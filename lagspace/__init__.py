"""State-space reconstruction and forecasting of time series on Spark."""
