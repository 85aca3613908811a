"""Loads, joins, features, views, feed, search and table checks."""
