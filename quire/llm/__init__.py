"""Operators for preparing language-model training data. Nothing else in quire imports this subpackage."""
