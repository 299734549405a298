"""Keyspace analytics on Spark: data structures of many keys as DataFrames, commands as plans over them."""
