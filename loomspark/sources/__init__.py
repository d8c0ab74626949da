"""Dataset registry, readers, transcript builders and sinks."""
