"""Operators for preparing a text corpus for model training."""
