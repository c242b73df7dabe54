"""Operators for preparing language-model training corpora.

Nothing outside this folder imports it.  Every operator takes a DataFrame and plain parameters and returns a
DataFrame; ``nearfold.llm.queries`` applies each one to its whole table.
"""
