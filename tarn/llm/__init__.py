"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it. Each module holds one operator with
its own general interface; :mod:`tarn.llm.queries` holds the thin ``opN_<name>``
queries over the supplied tables and :mod:`tarn.llm.oracles` their SQL.
"""
