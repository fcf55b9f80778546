"""The same run over pages that keep arriving."""
