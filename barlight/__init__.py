"""barlight: research over OHLCV bars, expressed as Spark DataFrame jobs."""
