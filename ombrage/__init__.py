"""Text pseudonymisation and corpus preparation as Spark DataFrame programs."""
