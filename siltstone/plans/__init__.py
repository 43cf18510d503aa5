"""Configuration, the search engine, request handlers, and the query catalogue."""
