"""Stock posting on Spark: feeds in, purchases, transfers and movements out."""
