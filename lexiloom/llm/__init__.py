"""Operators of a training-data pipeline; each module holds one operator, its query and its SQL twin."""

from . import decontaminate, exact_dedup, html_text, jaccard_join, license_scan, mixing, near_dups, pii, prefix_trie, resampling, toxicity, url_rules, warc  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
