"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; its queries and their SQL are in
:mod:`loomtext.llm.queries`.
"""
