"""factweave: relational facts about source code and text, as Spark DataFrames."""
