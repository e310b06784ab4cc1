"""sparkloom: profiling, rule mining and synthetic data on Spark DataFrames."""
