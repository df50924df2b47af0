"""Document text to knowledge graphs, and measures of those graphs, as Spark DataFrame plans."""
