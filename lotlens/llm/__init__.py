"""Operators for building training corpora.  Nothing else in lotlens imports this subpackage."""
