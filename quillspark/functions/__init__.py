"""Column functions: tokenizers, splitters, views of a text, small statistics over arrays."""
