"""lodeseek: a web-search analytics engine on PySpark DataFrames."""
