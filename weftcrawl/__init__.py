"""Crawl-and-extract analytics as set-oriented Spark dataflow."""
