"""Training-data operators: near duplicates, tokens, decontamination, toxicity, files and shards.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
