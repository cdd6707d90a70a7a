"""Operators of a training-data pipeline: mixing, near-duplicate removal, quality rules, secret scans, toxicity, packing,
token files, fingerprints, repeated passages and licence scans.  Nothing outside this subpackage imports it."""
