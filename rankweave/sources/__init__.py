"""sources of rankweave."""
