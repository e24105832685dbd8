"""Scalar functions: URLs, addresses, formats, markup and values."""
