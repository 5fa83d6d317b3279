"""Column functions; all run inside the JVM unless their docstring says otherwise."""
