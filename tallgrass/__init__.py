"""tallgrass: architecture analytics over source repositories as plain PySpark DataFrames."""
