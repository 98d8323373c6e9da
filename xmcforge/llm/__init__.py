"""Operators of a large-scale training-data pipeline (token counts, packing, sharding, search,
quality rules, duplicates, WARC archives, toxicity, source mixing).  Nothing else in the library
imports this subpackage; ``registry`` holds its queries."""
