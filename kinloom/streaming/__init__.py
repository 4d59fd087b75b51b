"""Job events as streams."""
