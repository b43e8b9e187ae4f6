"""feedmerge: multi-tenant inventory feed consolidation on Spark.

Vendor CSV feeds are scanned, renamed and cast by per-vendor mappings,
invalid rows are quarantined with reasons, SKUs are rewritten through
mapping tables, the best offer per SKU is kept, prices are computed with
exact decimal arithmetic, and deterministic outputs plus reports are
written.  Every step is a DataFrame transform; tenant rules are rows that
are joined in, so one plan serves every tenant of a batch.
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
