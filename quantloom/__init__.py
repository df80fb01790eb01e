"""Market-data analytics on Spark: panels keyed by instrument and date, as DataFrame -> DataFrame functions."""
