"""Training-data operators: extraction, packing, decontamination, language
identification, personal data, quality rules, line dedup, licence scans,
toxicity, near-duplicate joins, embedding
whitening, substring dedup and dataset manifests.  Nothing outside this package imports it.
"""
