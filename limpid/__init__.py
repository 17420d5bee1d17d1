"""Text hygiene for Spark: clean, normalise, coerce, validate, detect and scrub."""
