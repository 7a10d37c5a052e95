"""Skerry: search, chunking, profiling and monitoring of large document corpora as Spark jobs."""
