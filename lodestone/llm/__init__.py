"""Operators that prepare corpora for language models. Nothing outside this subpackage imports it."""
