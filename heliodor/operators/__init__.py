"""SELECT and DML as DataFrame operators."""
