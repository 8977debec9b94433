"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; ``pixelgrove.llm.queries``
registers its queries with the driver's entry module.
"""
