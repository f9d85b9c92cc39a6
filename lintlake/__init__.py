"""Static security analytics over large collections of text, on Spark DataFrames."""
