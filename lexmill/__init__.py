"""Text mining on Spark DataFrames: cleaning, statistics, graph ranking, topics."""
