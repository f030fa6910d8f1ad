"""Sources: schema catalogs and tables."""
