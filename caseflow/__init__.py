"""caseflow: time-ordered evidence analytics expressed as Spark plans."""
