"""Compositions of operators: corpus understanding and typed load."""
