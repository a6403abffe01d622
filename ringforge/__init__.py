"""A PySpark engine for ring tracks, and corpus operators beside it."""
