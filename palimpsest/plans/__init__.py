"""Query languages compiled to Column expressions."""
