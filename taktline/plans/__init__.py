"""The three runs from end to end. Each returns the result tables as plans."""
