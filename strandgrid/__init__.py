"""Fuzzy similarity analytics over DNA sequences, written for PySpark."""
