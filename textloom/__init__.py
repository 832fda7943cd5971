"""Spark-first search, provenance and version lineage over large multi-lingual text corpora."""
