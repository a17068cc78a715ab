"""Streams of documents: an extension, the batch engine doesn't need it."""
