"""Scalar parsers and numeric kernels."""
