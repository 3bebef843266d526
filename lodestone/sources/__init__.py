"""Files, segments and tables to read and write."""
