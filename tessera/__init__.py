"""Tessera: entity resolution over vectors and events, as Spark DataFrame jobs."""
