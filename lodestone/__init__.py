"""Text search, keyed state and block analytics as ordinary Spark plans."""
