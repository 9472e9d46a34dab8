"""Column builders: text in, Column out, no DataFrame touched."""
