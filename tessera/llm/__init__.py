"""Training-corpus operators: dedup, packing, classifiers, scans, mixing and search.

Nothing outside this subpackage imports it.
"""
