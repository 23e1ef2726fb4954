"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Each module holds one operator with a general interface; `queries` binds them to the given tables as opN_<name>."""
