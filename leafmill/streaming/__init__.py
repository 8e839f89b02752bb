"""Structured Streaming renditions of the ordered operators."""
