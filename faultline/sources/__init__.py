"""Tables, readers and writers."""
