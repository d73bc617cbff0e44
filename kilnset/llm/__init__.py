"""Training-data operators over document, vector and conversation tables."""
