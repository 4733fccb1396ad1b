"""Compilers from the query language to DataFrame plans."""
