"""The batch transforms over micro-batches, and keyed session state."""
