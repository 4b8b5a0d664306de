"""Named queries: each composes operators over the tables of one folder."""
