"""A PySpark engine for question banks and exam papers."""
