"""DataFrame -> DataFrame operators of the feed pipeline."""
