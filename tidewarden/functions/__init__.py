"""Column functions, vocabularies and scoring hooks."""
