"""Products over matrices that grow."""
