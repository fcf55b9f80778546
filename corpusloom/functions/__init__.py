"""Column functions: URLs, texts, dates. All are Catalyst expressions."""
