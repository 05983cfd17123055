"""Column functions: every one returns a Spark ``Column`` and stays in the JVM."""
