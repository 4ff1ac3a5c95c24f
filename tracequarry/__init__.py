"""Analytics of compiler and kernel-launch traces on Spark DataFrames."""
