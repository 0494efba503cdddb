"""lumenrank: search-visibility and content analytics expressed as Spark DataFrame plans."""
