"""tidemark: time-keyed tables, analytical SQL and change streams on PySpark."""
