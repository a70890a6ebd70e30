"""Retrieval and knowledge-base analytics on PySpark: lazy DataFrame plans, one module per operator family."""
