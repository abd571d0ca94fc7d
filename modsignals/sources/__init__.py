"""Reading and writing at the edges: CSV, JSON, text and partitioned tables."""
