"""Column-level functions: native expressions plus small Arrow/numpy helpers."""
