"""Column functions. None of them moves data; all stay inside code generation unless the docstring says otherwise."""
