"""Column expressions: everything here runs inside the JVM as built-in Spark functions."""
