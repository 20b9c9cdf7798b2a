"""A Spark engine for centroid-based clustering."""
