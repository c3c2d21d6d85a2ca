"""Column functions: pure expressions from columns to columns."""
