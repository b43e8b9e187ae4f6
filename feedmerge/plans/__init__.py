"""End-to-end plans: the multi-tenant batch job and the views that stand
the driver's tables in for vendor feeds, configs, ledgers and metrics."""
