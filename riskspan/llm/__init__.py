"""Training-data operators: scoring, filtering, de-duplication, sharding and packing of text corpora.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only where it exists.
"""
