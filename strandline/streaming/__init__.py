"""The same derivations on streams."""
