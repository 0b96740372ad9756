"""Card-transaction risk analytics as PySpark DataFrame operators."""
