"""Supply-chain early warning on Spark DataFrames."""
