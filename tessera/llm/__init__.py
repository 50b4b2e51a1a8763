"""Training-data operators; nothing outside this subpackage imports it.

Every module holds one operator with its own general interface; `queries.py` derives the digest
columns of the registered `opN_*` queries from them.
"""
