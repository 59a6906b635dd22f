"""The domain panel on the driver tables, and the registered queries with their SQL."""
