"""Column -> Column helpers that stay inside the JVM."""
