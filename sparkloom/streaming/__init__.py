"""Change sets, change-data capture and live queries over micro-batches."""
