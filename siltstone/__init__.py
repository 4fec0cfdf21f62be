"""Siltstone: ordered event logs (latest-wins key-value logs and append-only time series) as Spark DataFrame plans."""
