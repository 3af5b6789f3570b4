"""Graph, search and change-impact operators over DataFrames."""
