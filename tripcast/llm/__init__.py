"""Training-data operators: packing, deduplication, sharding, filters, extraction and scans."""
