"""Training-data operators: mixing, fingerprints, secrets, packing, token counts,
WARC archives, licences, quality rules, substring and near-duplicate removal.

Nothing outside this subpackage imports it.
"""
