"""Web-document discovery and change tracking as Spark DataFrame operations."""
