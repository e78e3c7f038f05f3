"""Column expressions: everything here is narrow and stays in the JVM."""
