"""Plans (what to copy, grant, drop) and the runs that carry them out."""
