"""Operators over streams: scoring against a trained map, windows with late data, and a running best per key."""
