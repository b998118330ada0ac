"""The three jobs put together: refresh the list, screen a batch, assess a batch."""
