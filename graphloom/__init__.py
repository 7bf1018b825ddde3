"""graphloom: exact graph centrality and benchmark reporting on Spark DataFrames."""
