"""Column functions: text, identity, vectors, filters, scores."""
