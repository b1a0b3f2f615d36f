"""Training-data operators: sharding, chat formatting, packing, BPE, dedup, filters, language id, PII.

Nothing outside this subpackage imports it.
"""
