"""Column functions: row-local, JVM-side, no shuffle."""
