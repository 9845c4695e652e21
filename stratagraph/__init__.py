"""Spark-first analytics for multilayer networks: features, influence, alignment and seed search."""
