"""tidemill: analytics jobs for PySpark, written with DataFrames and Structured Streaming."""
