"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Each module holds one operator
with its general interface; :mod:`threatloom.llm.queries` derives the thin
``opN_*`` queries from them.
"""
