"""The MDX subset: set expressions and two-axis queries."""
