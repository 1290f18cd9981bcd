"""Catalog snapshots as a stream."""
