"""Agent-memory analytics on Spark: retrieval, versioned facts, graph, sessions and context assembly as DataFrames."""
