"""Operators for large-scale training-data pipelines (text, web pages, vectors).

Nothing outside this subpackage imports it; ``mediacast.llm.queries`` registers
its queries with the driver entry when the subpackage is present.
"""
