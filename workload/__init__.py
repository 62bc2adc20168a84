"""The registered queries: flight tables and feeds derived from the driver's tables, and their SQL checks."""
