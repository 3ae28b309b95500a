"""Filescope: static file analysis over DataFrames of blobs."""
