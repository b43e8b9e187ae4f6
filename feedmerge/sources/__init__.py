"""Sources: vendor CSV feeds, SKU maps, tenant configs and file listings."""
