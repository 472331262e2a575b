"""Panel operators, each a function of DataFrames."""
