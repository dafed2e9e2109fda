"""Job events, as a table and as a stream."""
