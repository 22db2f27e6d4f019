"""Operators for building language-model training corpora.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``queries.py`` holds the registered ``opN_<name>`` queries.
"""
