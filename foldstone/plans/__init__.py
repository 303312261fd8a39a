"""Foldstone plans."""
