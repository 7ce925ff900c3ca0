"""bandloom: frequency-band image stores, budgets and quality metrics on PySpark."""
