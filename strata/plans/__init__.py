"""Whole queries: views over tables, the catalogue of queries, and the scan."""
