"""Streams: incoming files picked up as they arrive."""
