"""Reading records into raw tables, and writing tables."""
