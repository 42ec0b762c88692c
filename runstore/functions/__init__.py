"""Scalar functions and codecs, as column expressions where Spark can hold them."""
