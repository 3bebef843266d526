"""Column functions: text, codecs and identifiers."""
