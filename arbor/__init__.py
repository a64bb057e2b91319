"""arbor: versioned-tree analytics on Spark."""
