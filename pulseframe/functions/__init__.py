"""Column builders: closed-form expressions that stay inside the JVM."""
