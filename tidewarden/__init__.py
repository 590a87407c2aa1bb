"""tidewarden: message-safety and corpus analytics expressed as Spark DataFrame operations."""
