"""Operators for training-data corpora (packing, scans, dedup, quality, chat).

Nothing outside this subpackage imports it; deleting the folder leaves the
rest of the library working.
"""
