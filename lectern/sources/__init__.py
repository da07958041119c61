"""Reading files into segments."""
