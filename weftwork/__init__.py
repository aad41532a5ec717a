"""Weftwork: entity resolution and golden records as Spark plans."""
