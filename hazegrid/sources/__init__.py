"""Landed files in, result tables out."""
