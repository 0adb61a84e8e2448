"""copse: genealogical-tree analytics as plain Spark DataFrame plans."""
