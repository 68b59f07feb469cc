"""Operators of a training-data pipeline: language ID, piece encoding, Jaccard
join, LM scores, packing, chat formatting, vector near-dedup, quality, document
fingerprints and token counts.  Nothing else in the library imports this
subpackage.
"""
