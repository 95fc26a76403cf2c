"""DataFrame operators: capture, guards, canonical rows, apply, reads, operations."""
