"""Sources with explicit schemas, and sinks."""
