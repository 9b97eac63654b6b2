"""Training-data operators: packing, toxicity, near-dedup, mixing, LM scoring, PII, repeats, licences, vector search.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries and their SQL.
"""
