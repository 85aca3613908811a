"""Training-data operators: mixing, LM scoring, media, HTML extraction, sketches,
quality, near-duplicates, toxicity, tokenisation and language identification.

Nothing outside this subpackage imports it.
"""
