"""Recommendation-data engine on Spark: DataFrame operators, sources, plans and streaming projections."""
