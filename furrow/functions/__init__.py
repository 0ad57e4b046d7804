"""Column-level functions: null rules, text and number helpers."""
