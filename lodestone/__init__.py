"""Vector-search analytics on Spark: exact and approximate k-nearest neighbours as DataFrame operators."""
