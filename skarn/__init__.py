"""skarn: JSON documents and training-data pipelines as Spark DataFrames."""
