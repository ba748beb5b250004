"""Training-data operators over documents and pages, and their queries."""
