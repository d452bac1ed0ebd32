"""Part of the quire package."""
