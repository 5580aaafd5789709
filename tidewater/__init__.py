"""Tidewater: notice-stream analytics expressed as Spark DataFrame plans."""
