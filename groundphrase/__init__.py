"""Referring-expression data engine on PySpark."""
