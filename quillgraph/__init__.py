"""A knowledge-graph engine over notes and table rows, on Spark DataFrames."""
