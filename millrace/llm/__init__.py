"""Training-data operators: sharding, deduplication, decontamination, scoring, packing.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is there.
"""
