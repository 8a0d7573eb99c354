"""Search, citation analytics and incremental ingestion of legal text on Spark."""
