"""Column functions: text, spans and vectors. All of them stay in the JVM."""
