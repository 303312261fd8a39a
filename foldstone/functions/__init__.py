"""Foldstone functions."""
