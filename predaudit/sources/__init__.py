"""Reading tables of scored records and writing results."""
