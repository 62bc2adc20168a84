"""Flight-operations analytics on Spark: feed ETL, reports and display tables as plain DataFrame functions."""
