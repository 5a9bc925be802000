"""Catalogue quality and price comparison as Spark DataFrame transforms."""
