"""Column functions, and the UDFs where no built-in expression has the semantics."""
