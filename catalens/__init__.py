"""catalens: a PySpark engine that makes tabular data safe and legible for query authors."""
