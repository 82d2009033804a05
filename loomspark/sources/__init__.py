"""Readers: driver tables, stand-in views, landed files and small stores."""
