"""Column-expression helpers (JVM-side built-ins only)."""
