"""A query engine for typed classes with links, lists, sets, maps and dynamic values, on DataFrames."""
