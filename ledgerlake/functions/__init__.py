"""Column expressions and job parameters. No UDF: all of it stays in the JVM."""
