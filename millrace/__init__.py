"""millrace: declarative event pipelines and training-data operators on PySpark."""
