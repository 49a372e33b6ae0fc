"""Training-data operators: extraction, identification, encoding, duplicates, packing.

Nothing else in the library imports this package.
"""
