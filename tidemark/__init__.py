"""A PySpark engine for reviewing models that rank a daily price panel."""
