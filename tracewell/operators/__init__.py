"""Relational operators over captured responses, crawls, stores, searches and costs."""
