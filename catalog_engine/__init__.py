"""Product-sourcing analytics as plain PySpark DataFrame operators."""
