"""Operators of a training-data pipeline: formatting, scoring, cleaning and deduplication of text."""
