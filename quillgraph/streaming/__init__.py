"""An extension: incremental refresh of derived tables."""
