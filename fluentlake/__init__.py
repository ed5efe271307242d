"""Fluent queries over ordered lists of records, lowered to Spark plans."""
