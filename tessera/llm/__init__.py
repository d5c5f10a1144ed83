"""Training-data operators over document, page and vector tables.

Nothing outside this subpackage imports it. Each module holds one operator
with its general interface; :mod:`tessera.llm.queries` binds the operators to
the tables of a data folder.
"""
