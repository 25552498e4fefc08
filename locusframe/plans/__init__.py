"""Jobs: operators put together from input files to published tables."""
