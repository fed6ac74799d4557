"""Sampled k-mer analytics over sequence collections, as PySpark plans."""
