"""Spark-native k-mer and sequence analytics: sources, functions, operators, plans and streams over DataFrames."""
