"""Two-way synchronisation of two relational schemas as PySpark jobs."""
