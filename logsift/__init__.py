"""Security-log triage on Spark: every operator takes DataFrames and returns DataFrames."""
