"""Values, types and errors of the SQL dialect."""
