"""Reading vector tables and keeping manifests."""
