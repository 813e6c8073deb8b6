"""The queries of this subpackage and their SQL."""

from . import lines, mixing, near_duplicates, packing, splitting, subjects

QUERIES = {k: f for m in (lines, splitting, near_duplicates, packing, mixing, subjects) for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in (lines, splitting, near_duplicates, packing, mixing, subjects) for k, q in m.ORACLES.items()}
