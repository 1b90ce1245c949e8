"""Source-code property graphs on Spark: two tables of typed nodes and edges, derived and queried as DataFrames."""
