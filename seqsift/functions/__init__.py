"""Functions of Columns."""
