"""Analytics over the telemetry of distributed training, as Spark DataFrames."""
