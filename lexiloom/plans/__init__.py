"""Named queries over the driver tables, one module per operator family."""

from . import cleaning, curation, dedup, evals, softlabels, sources, table_valued, tokens, vectors  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
