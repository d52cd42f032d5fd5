"""Readers and writers. Paths may be on any file system Spark can reach."""
