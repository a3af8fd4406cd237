"""runledger: Spark-native analytics over job ledgers, event logs and run records.

Every operator is a plain function from DataFrames to a DataFrame; nothing is
collected to the driver.  The session belongs to the caller.
"""

__all__ = ["session", "schemas"]
