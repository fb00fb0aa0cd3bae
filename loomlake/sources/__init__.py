"""Readers of change feeds, label feeds, exported repositories and lexicon files."""
