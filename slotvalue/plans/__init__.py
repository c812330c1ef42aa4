"""The registered queries and the tables they run on."""
