"""Training-data operators: screening, redaction, de-duplication, tokenising and scoring of text.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; ``queries.py`` registers one query per operator.
"""
