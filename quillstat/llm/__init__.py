"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin ``opN_<name>`` queries over the standard tables are in
:mod:`quillstat.llm.queries`.
"""
