"""paperlake: scholarly search, citation metrics and text extraction as Spark jobs."""
