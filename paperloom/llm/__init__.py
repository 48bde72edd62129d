"""Training-data operators: quality, deduplication, packing, tokens, shards, links and media.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the contract queries over the driver's tables are in ``queries``.
"""
