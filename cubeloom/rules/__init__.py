"""The rules language: text, compiled form, and what is derived from it."""
