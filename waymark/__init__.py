"""Schema-migration analytics and corpus operators on PySpark."""
