"""Signal analytics over text corpora as DataFrame transformations."""
