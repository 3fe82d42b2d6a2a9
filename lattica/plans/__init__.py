"""Plan helpers: shared storage for cut lineage, star contraction."""
