"""Raw formats in, prepared tables out."""
