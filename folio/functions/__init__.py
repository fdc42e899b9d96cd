"""Column functions: everything here stays in the JVM and is open to the optimiser."""
