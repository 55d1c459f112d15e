"""loomtext: text, document and search analytics as PySpark DataFrame operators."""
