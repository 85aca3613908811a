"""Typed entities, relation paths, and the detail and aggregate plans over them."""
