"""tidewheel: durable-workflow data as DataFrames."""
