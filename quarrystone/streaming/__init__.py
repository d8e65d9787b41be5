"""Event-time operators on Structured Streaming; each works on a batch DataFrame too."""
