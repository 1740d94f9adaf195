"""Raw objects and their readers."""
