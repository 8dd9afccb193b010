"""Column -> Column helpers, all built from JVM-side expressions."""
