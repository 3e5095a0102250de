"""Tables: catalogs, CSV folders, and tables that Spark reads itself."""
