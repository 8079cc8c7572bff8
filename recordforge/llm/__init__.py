"""Operators for preparing large text corpora for model training.

Nothing outside this subpackage imports it. ``registry`` collects the queries and the SQL that checks them.
"""
