"""Tidewater: market-data analytics and corpus preparation as Spark DataFrame programs."""
