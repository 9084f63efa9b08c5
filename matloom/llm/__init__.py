"""Training-data operators: packing, archives, near-duplicates, decontamination, sharding and scoring.

Nothing outside this subpackage imports it.
"""
