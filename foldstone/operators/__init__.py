"""Foldstone operators."""
