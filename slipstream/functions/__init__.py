"""Column expressions. All native: nothing here leaves the JVM."""
