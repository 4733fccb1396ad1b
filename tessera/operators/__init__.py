"""Operators that are more than one expression: relations, views, searches and writes."""
