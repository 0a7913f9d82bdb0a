"""Analytics over collections of captured job postings, and training-data
operators, expressed as Spark DataFrame plans."""
