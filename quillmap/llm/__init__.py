"""Training-data operators for document corpora.

Nothing outside this subpackage imports it; ``queries.py`` holds its
registered queries and their SQL.
"""
