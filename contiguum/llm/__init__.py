"""Operators for building training corpora: tokenising, deduplication, search, scoring, sharding and packing.

Nothing outside this subpackage imports it.  Each module holds one operator with a general interface;
``queries`` turns them into the registered ``opN_<name>`` queries.
"""
