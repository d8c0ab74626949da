"""Training-data operators: sharding, search, near duplicates, packing, tokenization,
chat rendering, language identification, language-model scoring and secret scans.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
