"""Structured Streaming counterparts of the ordered operators; after all data has arrived they agree with the batch ones."""
