"""Vocabularies, indexes, guides and masks as operators on DataFrames."""
