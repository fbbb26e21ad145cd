"""tidewire: activity-stream analytics on Spark DataFrames."""
