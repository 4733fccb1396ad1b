"""Scalar building blocks that stay inside the JVM."""
