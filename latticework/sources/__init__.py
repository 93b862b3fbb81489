"""Readers and writers: tokenizer files, saved vocabularies and indexes."""
