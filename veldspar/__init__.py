"""veldspar: document retrieval, evidence analytics and corpus preparation on PySpark."""
