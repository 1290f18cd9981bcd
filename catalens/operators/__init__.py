"""Operators over catalog facts: collection, semantics, inference, rendering, validation, audit."""
