"""Foldstone sources."""
