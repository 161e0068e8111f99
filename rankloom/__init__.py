"""rankloom: rank fusion and retrieval evaluation on Spark DataFrames."""
