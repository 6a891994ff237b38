"""Plans, catalogs, policies and the decisions about them; nothing here needs a session."""
