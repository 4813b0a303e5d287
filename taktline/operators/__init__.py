"""Jobs over DataFrames: each takes and returns DataFrames and runs no action."""
