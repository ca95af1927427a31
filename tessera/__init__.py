"""Retrieval, memory and corpus analytics expressed as Spark DataFrame programs."""
