"""Network-forensics analytics on Spark: DataFrame operators, sources, sinks and functions."""
