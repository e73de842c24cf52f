"""Operators for large-scale training-data pipelines.

Every operator takes DataFrames and returns a DataFrame. Common rules, unless
an operator's docstring says otherwise: a null text is an empty text; repeated
rows each get their own result; an empty table gives an empty result with the
same schema; an input column named like an output column is replaced by it;
texts are processed whole, at any length.
"""
