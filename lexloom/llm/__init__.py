"""Training-data preparation on Spark: ten operators, their registered queries and SQL."""
