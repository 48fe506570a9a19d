"""Column expressions shared by the operators; everything here stays in the JVM."""
