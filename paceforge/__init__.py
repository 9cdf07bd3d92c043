"""paceforge: motorsport timing and telemetry analytics on Spark DataFrames."""
