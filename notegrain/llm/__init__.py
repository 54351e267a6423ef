"""Operators for large-scale training-data pipelines.

Every operator works on a table of documents (or pages), in the module named after it; ``queries``
holds the thin ``opN_<name>`` queries with their SQL, which ``__spark_entry__.py`` registers.
Nothing outside this subpackage imports it.
"""
