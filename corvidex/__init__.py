"""corvidex: document retrieval and corpus processing as PySpark DataFrame operators."""
