"""Operators for preparing large training corpora: counts, joins, filters, packing and archives.

Nothing else in the library imports this package; it only needs Spark, numpy, pandas and pyarrow,
and the tokenizer libraries for the operators that count or pack tokens.
"""
