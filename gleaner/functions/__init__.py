"""Column functions: JVM-side expressions only, no Python on the row path."""
