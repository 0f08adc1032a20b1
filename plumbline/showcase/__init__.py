"""Every operator wired to the sample tables, each with its SQL statement."""
