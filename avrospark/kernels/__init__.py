"""Vectorised kernels: block codecs, encoding and decoding of Arrow arrays, container files."""
