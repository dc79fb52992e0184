"""Tables, raw batches, manifests and sinks."""
