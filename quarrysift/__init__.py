"""quarrysift: document search, ranking and corpus preparation on Spark DataFrames."""
