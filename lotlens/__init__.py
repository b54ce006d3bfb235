"""Listing intelligence on Spark: DataFrame operators for dated listings, their photos and findings."""
