"""Corpus sources and result sinks."""
