"""Column builders. Unless a docstring says otherwise, a null argument gives null."""
