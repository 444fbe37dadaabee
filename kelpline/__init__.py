"""Similarity retrieval over text, image and audio collections, expressed as Spark DataFrames."""
