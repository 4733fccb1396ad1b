"""The same compilers over Structured Streaming tables."""
