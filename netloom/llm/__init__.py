"""Training-data operators: packing, cleaning, scanning, deduplication, tokenisation and archives.

Nothing else in the library imports this subpackage.
"""
