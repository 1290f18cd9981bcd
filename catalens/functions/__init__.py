"""Column functions of the engine; all are built-in expressions, none is a Python UDF."""
