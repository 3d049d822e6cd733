"""factloom: a fact-ledger engine and training-data operators on Spark DataFrames."""
