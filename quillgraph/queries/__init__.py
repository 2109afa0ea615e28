"""The engine's operators over the driver's tables, each with SQL that gives the same rows."""
