"""DataFrame to DataFrame transforms.  None collects; side tables are joined, broadcast only within a checked bound."""
