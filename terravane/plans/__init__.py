"""Structured queries: catalog, compiler and tools."""
