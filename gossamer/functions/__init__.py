"""Column expressions: nothing here runs Python on an executor."""
