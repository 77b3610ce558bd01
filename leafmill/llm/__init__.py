"""Operators of training-data pipelines, each with the query that applies it."""

from . import byte_pairs, chat, manifest, near_duplicates, order_minhash, packing, page_text, partial_matching, personal_data, quality, simhash, tokens, variants
from .common import ORACLES, QUERIES

assert byte_pairs and chat and manifest and near_duplicates and order_minhash and packing and page_text and partial_matching and personal_data and quality and simhash and tokens and variants  # the imports fill the registry

__all__ = ["ORACLES", "QUERIES"]
