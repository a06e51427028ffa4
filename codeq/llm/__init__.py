"""Operators for preparing training data: ten jobs over a table of documents, and their queries."""
