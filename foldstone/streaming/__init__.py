"""Foldstone streaming."""
