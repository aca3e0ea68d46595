"""Operators for preparing training text at corpus scale.

Every operator takes DataFrames and returns DataFrames; nothing outside this
subpackage imports it.  Registered queries live in :mod:`glyphframe.llm.queries`.
"""
