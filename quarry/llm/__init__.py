"""Training-data operators: sharding, token files, near-duplicates, vector search, quality, mixing, BPE, text search, page
extraction, chat formatting, packing, collocations and whitening. Nothing outside this package imports it.
"""
