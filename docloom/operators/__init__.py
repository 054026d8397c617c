"""Operators on tables of documents, chunks, vectors, links and logs."""
