"""Relational operators over listings, chunks, manifests and logs."""
