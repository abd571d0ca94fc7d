"""Bindings of the test tables to the library's tables, and the registered queries."""
