"""Column functions of the retrieval engine: keys, text, paths and vectors, all within the JVM."""
