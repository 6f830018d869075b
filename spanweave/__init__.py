"""Span analytics on Spark: span algebra, corpus shaping, generation and scoring as DataFrame operators."""
