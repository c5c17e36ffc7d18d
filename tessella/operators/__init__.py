"""Operators over pixel, tile, label and object relations."""
