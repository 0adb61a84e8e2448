"""Column expressions: no joins, no actions, JVM-side only."""
