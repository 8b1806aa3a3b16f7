"""Session settings and the cutting of lineage."""
