"""Analytics over concurrent software changes, on Spark DataFrames."""
