"""strataspark: code-evidence analytics expressed as Spark DataFrame plans."""
