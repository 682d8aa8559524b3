"""Relations: delimited and fixed-width text files, Parquet, generated tables, snapshots, and how names resolve to them."""
