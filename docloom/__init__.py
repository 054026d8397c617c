"""docloom: knowledge-base analytics as Spark DataFrames."""
