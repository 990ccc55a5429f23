"""operators of rankweave."""
