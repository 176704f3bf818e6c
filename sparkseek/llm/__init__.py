"""Operators for building training corpora: text, token and vector work at corpus scale."""
