"""Search, ranking and audit of text-note corpora as Spark DataFrame plans."""
