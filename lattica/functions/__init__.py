"""Codecs of literals and of agtype text, and accessors of path columns."""
