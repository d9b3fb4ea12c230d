"""Column functions and small relational functions: search terms, similarity, string flattening."""
