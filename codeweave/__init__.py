"""codeweave: code-structure graph analytics and training-data operators on PySpark."""
