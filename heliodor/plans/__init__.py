"""From statement text to bound Spark columns."""
