"""Relational, graph and retrieval operators: DataFrame in, DataFrame out."""
