"""Plans made of several operators, and the shared folder they cut lineage with."""
