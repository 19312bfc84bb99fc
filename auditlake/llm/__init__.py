"""Training-data operators: dedup, mixing, fingerprints, toxicity, WARC, secrets, PII, packing, search.

Nothing else in the library imports this subpackage.
"""
