"""Listing intelligence on Spark: DataFrame operators for classified-listing data."""
